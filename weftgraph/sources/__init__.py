"""Files in and out, and text renderings of results."""
