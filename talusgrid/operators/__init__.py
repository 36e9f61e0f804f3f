"""DataFrame operators over cell, node, sample and node-hour tables."""
