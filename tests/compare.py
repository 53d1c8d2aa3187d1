"""Run registered queries beside their SQL and report differences: python tests/compare.py [folder] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    out = {}
    for c in df.columns:
        col = df[c]
        if pd.api.types.is_datetime64_any_dtype(col):
            col = col.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(col):
            col = col.astype(str)
        elif pd.api.types.is_float_dtype(col):
            col = col.round(9).map(lambda v: "None" if pd.isna(v) else repr(float(v)))
        elif pd.api.types.is_integer_dtype(col):
            col = col.map(lambda v: repr(int(v)))
        else:
            col = col.map(lambda v: "None" if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v)) else str(v))
        out[c] = col.replace("NaT", "None")
    return pd.DataFrame(out).sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df, con, sql: str) -> str | None:
    """None when rows agree, else what differs."""
    got_raw = spark_df.toPandas()
    want_raw = con.execute(sql).df()
    if sorted(got_raw.columns) != sorted(want_raw.columns):
        return f"columns {sorted(got_raw.columns)} != {sorted(want_raw.columns)}"
    if len(got_raw) != len(want_raw):
        return f"rows {len(got_raw)} != {len(want_raw)}"
    if not len(got_raw):
        return "no rows"
    got, want = _norm(got_raw), _norm(want_raw)
    for c in got.columns:
        bad = got[c] != want[c]
        if bad.any():
            i = bad.idxmax()
            return f"column {c}: {int(bad.sum())} differ, e.g. {got.loc[i].to_dict()} != {want.loc[i].to_dict()}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tracewarden.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(cores="8")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            problem = differences(df, con, sql) if sql else f"(no SQL) {df.count()} rows"
        except Exception as ex:  # report and go on
            problem = f"{type(ex).__name__}: {str(ex)[:1500]}"
        ok = problem is None or problem.startswith("(no SQL)")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
