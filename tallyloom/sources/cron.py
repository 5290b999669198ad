"""When a cron expression of six fields (second minute hour day month weekday) fires next."""

from __future__ import annotations

from datetime import datetime, timedelta

_RANGES = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
_NAMES = [{}, {}, {}, {}, dict(zip("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), range(1, 13))), dict(zip("SUN MON TUE WED THU FRI SAT".split(), range(7)))]


def _field(text: str, nth: int) -> set[int]:
    low, high = _RANGES[nth]
    number = lambda x: _NAMES[nth].get(x.upper(), None) if x.upper() in _NAMES[nth] else int(x)
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = map(number, span.split("-"))
        else:
            a = number(span)
            b = high if step else a
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(text)
        out |= set(range(a, b + 1, int(step or 1)))
    if nth == 5 and 7 in out:
        out.add(0)
    return out


def next_after(cron: str, base: datetime) -> datetime | None:
    """The first time after ``base`` that matches; None for a bad or never matching expression."""
    try:
        parts = cron.split()
        if len(parts) != 6:
            return None
        second, minute, hour, day, month, weekday = (_field(p, i) for i, p in enumerate(parts))
    except (ValueError, AttributeError):
        return None
    t = base.replace(microsecond=0) + timedelta(seconds=1)
    for _ in range(366 * 8):
        if t.month in month and t.day in day and (t.weekday() + 1) % 7 in weekday:
            for h in sorted(x for x in hour if x >= t.hour):
                first_minute = t.minute if h == t.hour else 0
                for m in sorted(x for x in minute if x >= first_minute):
                    first_second = t.second if (h, m) == (t.hour, t.minute) else 0
                    for s in sorted(x for x in second if x >= first_second):
                        return t.replace(hour=h, minute=m, second=s)
        t = (t + timedelta(days=1)).replace(hour=0, minute=0, second=0)
    return None
