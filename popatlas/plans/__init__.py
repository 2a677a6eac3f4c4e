"""Plan shapes shared by the operators: ranks, quantiles, tree paths, size checks."""
