"""Timestamps to integer timeslots, independent of the session time zone."""

from __future__ import annotations

from datetime import datetime

# Seconds are counted from year 1 so that they are positive for every valid
# timestamp and truncating division equals floor.
_EPOCH = "0001-01-01 00:00:00"


def timeslot(ts: str, start: str, slot_seconds: int) -> str:
    seconds = f"cast(cast(cast({ts} as timestamp_ntz) - timestamp_ntz'{_EPOCH}' as interval second) as bigint)"
    since = datetime.fromisoformat(start) - datetime.fromisoformat(_EPOCH)
    # Shift the count so that ``start`` falls on a multiple of the slot width.
    first, shift = divmod(int(since.total_seconds()), slot_seconds)
    if shift:
        first, seconds = first + 1, f"({seconds} + {slot_seconds - shift})"
    return f"cast({seconds} div {slot_seconds} - {first} as int)"
