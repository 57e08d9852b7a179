"""DataFrame to DataFrame operators over moments, detections, drafts, identities and uploads."""
