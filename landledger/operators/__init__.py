"""DataFrame to DataFrame operators: resolution, lifecycle, cost and score, ranking, reports."""
