"""Run queries against their SQL checks: python tools/check.py [sf] [name-prefix ...]."""

import signal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from pitgrid import build_session  # noqa: E402
from pitgrid.plans import all_queries  # noqa: E402
from pitgrid.plans.bridge import BASE_TABLES  # noqa: E402
from pitgrid.plans.registry import oracle_text, runnable  # noqa: E402


LIMIT = 60


def stop(*_):
    raise TimeoutError(f"over {LIMIT} s")


signal.signal(signal.SIGALRM, stop)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark, con, q, sf_dir):
    t0 = time.time()
    df = runnable(q)(spark, sf_dir)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    t1 = time.time()
    print(f"  [{q.name} spark {t1 - t0:.1f}s]", file=sys.stderr, flush=True)
    text = oracle_text(q)
    if text is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0, bool(got)
    want = sorted(con.execute(text).fetchall(), key=key)
    t2 = time.time()
    if got == want:
        return f"ok {len(got)}" + ("" if got else " EMPTY"), t1 - t0, t2 - t1, True
    gs, ws = set(got), set(want)
    only_g, only_w = [r for r in got if r not in ws], [r for r in want if r not in gs]
    msg = f"MISMATCH got {len(got)} want {len(want)}; only spark {len(only_g)} only sql {len(only_w)}"
    return msg + f"\n   spark {only_g[:3]}\n   sql   {only_w[:3]}", t1 - t0, t2 - t1, False


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session("check"), connect(sf_dir)
    bad = []
    for q in all_queries().values():
        if prefixes and not q.name.startswith(prefixes):
            continue
        signal.alarm(LIMIT)
        try:
            msg, a, b, ok = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, a, b, ok = f"ERROR {type(e).__name__} {str(e)[:900]}", 0, 0, False
        signal.alarm(0)
        print(f"{q.name:34s} {a:6.2f}s {b:6.2f}s {msg}", flush=True)
        if not ok:
            bad.append(q.name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
