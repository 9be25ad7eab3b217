"""Readers: text formats, split lists, weights and pose stores."""
