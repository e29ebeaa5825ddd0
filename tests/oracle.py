"""Rows of a query and of its SQL in one comparable form."""

import glob
import math
import os

import duckdb
import numpy as np


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _value(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) else round(v, 9)
    return None if v is None or str(v) in ("<NA>", "NaT") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([_value(v) for v in r]) for r in df[cols].itertuples(index=False))
