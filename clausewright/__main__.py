"""Command line of the engine.

python -m clausewright list | tables ROOT | demo OUT
python -m clausewright sql QUERY | schema QUERY ROOT | explain QUERY ROOT
python -m clausewright run QUERY ROOT OUT | count QUERY ROOT | head QUERY ROOT [ROWS]
python -m clausewright profile TABLE ROOT | verify-metadata ROOT OUT | gates ROOT
python -m clausewright search ROOT WORDS... | retrieve ROOT WORDS... | document ROOT ID
python -m clausewright standards ROOT [NAME] | laboratories ROOT [NAME] | stats ROOT | sources ROOT | health ROOT
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .plans import all_queries, all_sql
from .plans.assembly import GATES
from .session import build_session
from .sources import demo
from .sources.tables import table


def profile(s: SparkSession, root: str, name: str) -> DataFrame:
    """Rows, nulls and approximate distinct values of each column of a table."""
    df = table(s, root, name)
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.struct(F.count_if(F.col(c).isNull()), F.approx_count_distinct(c)).alias(c) for c in plain)).first()
    return s.createDataFrame([(c, row["rows"], row[c][0], row[c][1]) for c in plain], "column string, rows long, nulls long, distinct_values long")


def gates(s: SparkSession, root: str) -> DataFrame:
    """All gates of all tables."""
    every = None
    for name in GATES:
        one = all_queries()[name](s, root).withColumn("gate", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every


SHOWN: dict[str, Callable[..., DataFrame]] = {
    "head": lambda s, q, root, n="20": all_queries()[q](s, root).limit(int(n)),
    "count": lambda s, q, root: all_queries()[q](s, root).agg(F.count(F.lit(1)).alias("n")),
    "profile": lambda s, name, root: profile(s, root, name),
    "gates": gates,
    "search": lambda s, root, *words: api.search(s, root, " ".join(words)),
    "retrieve": lambda s, root, *words: api.retrieve(s, root, " ".join(words)),
    "document": lambda s, root, key: api.document(s, root, int(key)),
    "standards": api.standards,
    "laboratories": api.laboratories,
    "stats": api.stats,
    "sources": api.sources,
    "health": api.health,
}


def main(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("", [])
    known = all_queries()
    named = command in ("sql", "schema", "explain", "run", "count", "head")
    if command == "list":
        print("\n".join(sorted(known)))
    elif named and (not rest or rest[0] not in known):
        print(__doc__)
        return 2
    elif command == "sql":
        print(all_sql().get(rest[0], "no SQL states this query"))
    elif command == "tables" and rest:
        print("\n".join(sorted(n.removesuffix(".parquet") for n in os.listdir(rest[0]) if n.endswith(".parquet"))))
    elif command == "demo" and rest:
        demo.write(build_session(), rest[0])
    elif command in ("schema", "explain") and len(rest) == 2:
        df = known[rest[0]](build_session(), rest[1])
        print(df.schema.simpleString()) if command == "schema" else df.explain("formatted")
    elif command == "run" and len(rest) == 3:
        known[rest[0]](build_session(), rest[1]).write.parquet(rest[2])
    elif command == "verify-metadata" and len(rest) == 2:
        known["metadata_verification"](build_session(), rest[0]).write.parquet(rest[1])
    elif command in SHOWN and rest:
        SHOWN[command](build_session(), *rest).show(200, truncate=100)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
