"""DataFrame operators: filters, policies, retrieval, windows, metrics, models."""
