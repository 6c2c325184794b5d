"""DataFrame library for comparing skeleton reconstructions at scale."""
