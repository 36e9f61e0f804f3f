"""Table scans, manifests, sinks and the shared work folder."""
