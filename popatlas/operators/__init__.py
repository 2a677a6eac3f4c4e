"""DataFrame-to-DataFrame operators over a world and its event log."""
