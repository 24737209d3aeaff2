"""Part of pairloom: operators."""
