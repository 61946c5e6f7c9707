"""Reading and writing: JSON Lines with quarantine, media listings, chunked transcripts, reports."""
