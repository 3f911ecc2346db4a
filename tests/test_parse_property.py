"""Property test of the one-pass parser: random log lines, parsed by Spark
and by Python's ``re`` with the same pattern plus the coercion rules, must
agree field for field (including which lines are rejected)."""
import datetime as dt
import math
import re

import random

import pytest

from botlog.functions.logformat import LOG_PATTERN
from botlog.operators import parse

PY = re.compile(LOG_PATTERN)
ALPHA = list("abcXYZ019/.-_?=&:;\"[] \t") + ["é", "\u00a0", "٢", "☃"]
WORDCH = list("abz09./-_")


def _token(r, lo=0, hi=8, chars=ALPHA):
    return "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))


def _line(r):
    any_ = lambda: _token(r, 1, 6, WORDCH) if r.random() < 0.7 else _token(r)
    day = r.randint(1, 28)
    when = r.choice([f"{day:02d}/Nov/2025:06:31:10 +1100", f"{day:02d}/Jan/2024:23:59:59 -0030",
                     "junk", "31/Feb/2024:00:00:00 +0000"])
    proto = r.choice(["HTTP/1.1", "HTTP/2", "", 'a"b'])
    status = r.choice(["200", "404", "x", "", "٢٠٠", "99999999999999999999"])
    size = r.choice(["12", "-", "1e3", "1.9", "12d", "nan", "", "0.", "-5"])
    ref = "-" if r.random() < 0.5 else _token(r)
    prefix = r.choice(["", "", "junk "])
    suffix = r.choice(["", " trailing", '"'])
    return (f'{prefix}{any_()} - - [{when}] "{any_()} {any_()} {proto}" {status} {size} '
            f'"{ref}" "{any_()}"{suffix}')


def _expected(line):
    m = PY.match(line)
    if not m:
        return None
    ip, when, method, path, proto, status, size, ref, ua = m.groups()
    try:
        ts = dt.datetime.strptime(when, "%d/%b/%Y:%H:%M:%S %z").astimezone(dt.timezone.utc).replace(tzinfo=None)
    except ValueError:
        ts = None
    st_ = int(status) if status.isascii() and status.isdigit() and int(status) < 2**63 else None
    try:
        b = float(size) if size[-1:].isdigit() or size.endswith(".") else None
        b = int(b) if b is not None and math.isfinite(b) else 0
    except ValueError:
        b = 0
    return (ip, ts, method, path, proto, st_, b, ref, ua)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parser_matches_python_regex(spark, seed):
    r = random.Random(seed)
    batch = [_line(r) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in batch], "value string")
    got = [tuple(g) for g in parse.parse_log_lines(df).drop("tz_offset").collect()]
    got = sorted(((g[0], g[1].replace(tzinfo=None) if g[1] else None) + g[2:] for g in got), key=repr)
    exp = sorted((e for e in map(_expected, batch) if e is not None), key=repr)
    assert len(exp) > 200
    assert got == exp
    assert parse.rejected_lines(df).count() == len(batch) - len(exp)
