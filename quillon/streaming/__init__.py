"""Extension: the baseline's and the ranking's sufficient statistics kept up to date over a stream of contrasts."""
