"""DataFrame operators over trace sets."""
