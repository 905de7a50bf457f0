"""English time phrases to a range, with the clock given."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_UNITS = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(weeks=1), "month": timedelta(days=30), "year": timedelta(days=365)}


def parse(phrase: str, now: datetime) -> tuple[datetime, datetime] | None:
    """(start, end) of ``last N units``, ``N units ago``, today, yesterday, this or last week, month; None if unknown.

    Weeks begin on Sunday; all is in UTC.
    """
    p = phrase.lower().strip()
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    sunday = day - timedelta(days=(day.weekday() + 1) % 7)
    named = {
        "today": (day, now), "yesterday": (day - timedelta(days=1), day), "this week": (sunday, sunday + timedelta(days=7)), "last week": (now - timedelta(days=7), now),
        "this month": (day.replace(day=1), now), "last hour": (now - timedelta(hours=1), now), "last month": (now - timedelta(days=30), now),
    }
    if p in named:
        return named[p]
    m = re.fullmatch(r"(?:last|past) (\d+) (minute|hour|day|week|month|year)s?", p)
    if m:
        return now - int(m[1]) * _UNITS[m[2]], now
    m = re.fullmatch(r"(\d+) (day|week|month|year)s? ago", p)
    if m:
        start = day - int(m[1]) * _UNITS[m[2]]
        return start, start + timedelta(days=1)
    return None
