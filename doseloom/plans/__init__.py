"""End-to-end jobs and the pieces they share (size checks, saved steps)."""
