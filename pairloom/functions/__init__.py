"""Part of pairloom: functions."""
