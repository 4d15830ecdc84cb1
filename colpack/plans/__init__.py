"""The registered queries of the compression engine, and their oracle SQL."""
