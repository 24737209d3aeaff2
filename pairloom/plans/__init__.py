"""Part of pairloom: plans."""
