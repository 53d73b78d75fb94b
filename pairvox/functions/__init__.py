"""Part of pairvox."""
