"""DataFrame operators: ranking metrics, bootstrap, profiles, relational steps, graphs and statistics."""
