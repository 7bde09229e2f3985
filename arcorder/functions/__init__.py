"""Part of arcorder."""
