"""Part of pairloom: streaming."""
