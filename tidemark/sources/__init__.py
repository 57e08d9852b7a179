"""Reading nested JSON, line-delimited logs, detections and listings; writing tables that replace or merge."""
