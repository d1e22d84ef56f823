"""Query plans: compositions of operators (merge job, score job, catalogue)."""
