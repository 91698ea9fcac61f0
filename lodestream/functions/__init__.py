"""Part of lodestream; see README.md."""
