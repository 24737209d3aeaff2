"""Part of pairloom: sources."""
