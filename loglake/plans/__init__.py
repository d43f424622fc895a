"""Plan inspection: is a query pruned, is a join broadcast."""
