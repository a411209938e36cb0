"""Writers: the findings table (K1, K2) and comment tables (K3-K5)."""
