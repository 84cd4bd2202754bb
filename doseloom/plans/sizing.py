"""Broadcast only what has been counted."""

from __future__ import annotations

# Rows of a weight table or variant list (a few short columns, under 100 bytes
# each) that still make a hash relation an executor can hold several times.
BROADCAST_ROWS = 1_000_000

