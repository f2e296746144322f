"""Part of palisand; see README.md."""
