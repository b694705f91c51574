"""Analytics over ballots, marks and cast-vote records on Spark."""
