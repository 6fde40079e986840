"""Part of strataline; see README.md."""
