"""Command line: [HOT=1] python -m tests.check SF [prefix ...]: agreement and seconds per query."""

from __future__ import annotations

import os
import sys
import time
import traceback

from tests.compare import diff, duck
from voxledger.catalog import load
from voxledger.session import local_session


def main() -> int:
    sf = f"/root/testdata/sf{sys.argv[1]}"
    want = sys.argv[2:]
    reg = load()
    spark, con, bad = local_session(), duck(sf), 0
    if os.environ.get("HOT"):  # small pieces, so that most groups have several
        spark.conf.set("spark.voxledger.pieceRows", "16")
    for name, fn in reg.QUERIES.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            if name in reg.SQL:
                msg = diff(spark, con, fn, reg.SQL[name], sf)
            else:
                msg = None if fn(spark, sf).count() else "no rows"
        except Exception as e:
            msg = (str(e) or traceback.format_exc())[:1500]
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {time.time() - t:6.2f}s {name}{'' if name in reg.SQL else ' (rows only)'} {msg or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
