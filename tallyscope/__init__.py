"""Account-behaviour analytics over transaction ledgers, as Spark DataFrame jobs."""
