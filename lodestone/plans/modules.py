"""Python modules made from the rows of `part`, so that queries over source have as many rows as the table.

Row k gives one module of eight kinds (k % 8); sixteen modules share a namespace, a folder `box<k // 16>`. In the
templates {k} is the row's key, {a} = k - 1, {b} = k + 16, {c} = k - 4 and {n} = k // 16. What a query should find
follows from the row's kind, so its SQL is rows of templates over `part`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.ranking import dealt

TEMPLATES = [
    """import hashlib
from os import path as p

def digest_{k}(data, *, name='x'):
    \"\"\"Convert data to digest.\"\"\"
    return hashlib.sha256(data).hexdigest()

class Store{k}:
    @staticmethod
    def save(self, rows):
        return self.check(rows)
    def check(self, rows, **kw):
        def inner(x):
            return p.join(x)
        return inner(rows)
""",
    """from m{a} import digest_{a}
import m{b} as other

def use_{k}(value):
    digest_{a}(value)
    other.digest_{b}(value)
    missing_{k}(value)
    return len(value)
""",
    """import hashlib as h
import json

def restore_{k}(text):
    value = json.loads(text)
    h = value
    return h.sha256(text)
""",
    "def broken_{k}(:\n",
    """class Base{k}:
    def run(self, n):
        raise NotImplementedError
    def __call__(self):
        return self.run(1)

class Child{k}(Base{k}):
    def __init__(self, n):
        super().run(n)
        super().gone(n)
    def count(self, n):
        global TOTAL
        TOTAL = n
        return TOTAL(n) == 2
""",
    """import json
print(json.dumps({'part': {k}}))
""",
    """from .m{c} import restore_{c}
LIMIT = 3

def late_{k}(items, most: int = LIMIT):
    restore_{c}(items)
    json.loads(items)
    import json
    return [cut_{k}(i) for i in items]
""",
    """def rows_{k}_to_table(rows: Rows) -> Table:
    \"\"\"Turn rows into a table.\"\"\"
    return rows

def table_from_rows(rows):
    \"\"\"Render no rows.\"\"\"
    return rows
""",
]
KINDS = len(TEMPLATES)
PATHS = ["box{n}/m{k}.py"] * 7 + ["box{n}/tests/test_m{k}.py"]


def filled(template: str):
    """A template filled in from p_partkey."""
    k = F.col("p_partkey")
    out = F.lit(template)
    for mark, value in (("{k}", k), ("{a}", k - 1), ("{b}", k + 16), ("{c}", k - 4), ("{n}", F.floor(k / 16))):
        if mark in template:
            out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def _by_kind(templates: list[str]):
    """The template of a row's kind, filled in; only that one is made."""
    out = F.when(F.lit(False), "")
    for kind, t in enumerate(templates):
        out = out.when(F.col("p_partkey") % KINDS == kind, filled(t))
    return out


def source_path():
    """The path of a row's module."""
    return _by_kind(PATHS)


def parts(spark, sf_dir: str, *columns: str):
    """Rows of part, dealt before anything long is made of them."""
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *columns), "p_partkey")


def modules(spark, sf_dir: str):
    """source_id (the path), code, namespace, test_path of all modules. Spark takes their size for that of the keys, so a hint keeps
    them from being broadcast."""
    part = parts(spark, sf_dir)
    path = source_path()
    return part.select(path.alias("source_id"), _by_kind(TEMPLATES).alias("code"), F.concat(F.lit("box"), F.floor(F.col("p_partkey") / 16)).alias("namespace"), path.contains("/tests/").alias("test_path")).hint("merge")


def places(spark, sf_dir: str):
    m = modules(spark, sf_dir)
    return m.select("source_id", "namespace", F.col("source_id").alias("path"), F.lit(False).alias("cell"))


def _sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, int):
        return f"{x}::BIGINT"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_sql_value, x)) + "]::VARCHAR[]"
    out = "'" + x.replace("'", "''") + "'"
    for mark, value in (("{k}", "p_partkey"), ("{a}", "(p_partkey - 1)"), ("{b}", "(p_partkey + 16)"), ("{c}", "(p_partkey - 4)"), ("{n}", "(p_partkey // 16)")):
        if mark in x:
            out = f"replace({out}, '{mark}', {value}::VARCHAR)"
    return out


def expected(columns: str, rows: dict[int, list[tuple]]) -> str:
    """SQL over part: for each module of a kind its rows; the module's path stands before them as source_id."""
    parts = []
    for kind, of_kind in sorted(rows.items()):
        for r in of_kind:
            values = [PATHS[kind], *r]
            parts.append("SELECT " + ", ".join(f"{_sql_value(v)} AS {c}" for v, c in zip(values, ["source_id", *columns.split()], strict=True)) + f" FROM part WHERE p_partkey % {KINDS} = {kind}")
    return " UNION ALL ".join(parts)
