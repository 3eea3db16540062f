"""The memory across runs: small tables kept as Parquet, a new version of a table with each change."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import NotFoundError, ReconError

SCHEMAS = {
    "Meta": "key string, value string",
    "Profile": "id long, name string, parse_spec_json string, last_fingerprint_id long, created_at string",
    "LoadedFile": "id long, file_name string, absolute_path string, size_bytes long, sha256 string, format string, encoding string, loaded_at string, row_count long, dataset_table string, profile_id long, fingerprint_id long",
    "Fingerprint": "id long, loaded_file_id long, profile_id long, fingerprint_json string, drift_warnings_json string, computed_at string",
    "DatasetColumn": "id long, loaded_file_id long, position int, name_raw string, name_norm string, sql_name string, inferred_type string, number_format string, null_count long, distinct_count long",
    "ReconPair": "id long, name string, profile_a_id long, profile_b_id long, created_at string",
    "ColumnMapping": "id long, recon_pair_id long, role string, level int, col_a string, col_b string, norm_mode string",
    "JoinKeyStat": "id long, recon_pair_id long, file_a_id long, file_b_id long, col_a string, col_b string, uniqueness_a double, uniqueness_b double, overlap_ratio double, computed_at string, null_rate_a double, null_rate_b double",
    "ColumnHierarchy": "id long, loaded_file_id long, parent_name string, child_name string, parent_distinct long, child_distinct long, consistency double, kind string, computed_at string",
    "Run": "id long, run_uuid string, recon_pair_id long, loaded_file_a_id long, loaded_file_b_id long, config_json string, started_at string, finished_at string, total_findings long",
    "RunLevelStat": "id long, run_id long, level int, examined long, matched long, only_a long, only_b long, differ long",
}


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class Catalog:
    """Catalogue tables live on the driver while in use, as they are small; datasets and findings never do.

    Changes of several tables are one: their new versions are written first, then one commit file that names the version of
    every table appears by renaming. Versions that no commit names don't exist for readers, and the rename fails where another
    writer has made that commit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rows: dict[str, list[dict]] = {}
        self.commit, self.versions = self._last_commit()
        for t, schema in SCHEMAS.items():
            at = f"{self.root}/catalog/{t}/{self.versions[t]}" if t in self.versions else None
            self.rows[t] = [r.asDict() for r in spark.read.schema(schema).parquet(at).collect()] if at else []
        if not self.rows["Meta"]:
            self.rows["Meta"] = [{"key": "hmac_salt", "value": uuid.uuid4().hex + uuid.uuid4().hex}]
            self.save("Meta")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _last_commit(self) -> tuple[int, dict[str, str]]:
        fs, p = self._fs(f"{self.root}/catalog/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = sorted(int(n) for n in names if n.isdigit())
        if not done:
            return 0, {}
        r = self.spark.read.text(f"{self.root}/catalog/commits/{done[-1]}").first()
        return done[-1], json.loads(r.value)

    def save(self, *tables: str) -> None:
        made = dict(self.versions)
        for t in tables:
            made[t] = uuid.uuid4().hex
            self.table(t).coalesce(1).write.parquet(f"{self.root}/catalog/{t}/{made[t]}")
        fs, new = self._fs(f"{self.root}/catalog/commits/new-{uuid.uuid4().hex}")
        fs.mkdirs(new.getParent())
        out = fs.create(new)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalog/commits/{self.commit + 1}")
        if fs.exists(at) or not fs.rename(new, at):
            fs.delete(new, False)
            raise ReconError("another writer has changed the catalogue; nothing is saved")
        self.commit, self.versions = self.commit + 1, made

    def table(self, table: str) -> DataFrame:
        names = [x.strip().split()[0] for x in SCHEMAS[table].split(",")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows[table]], SCHEMAS[table])

    @property
    def salt(self) -> str:
        return next(r["value"] for r in self.rows["Meta"] if r["key"] == "hmac_salt")

    def add(self, table: str, **row) -> int:
        row["id"] = max((r["id"] for r in self.rows[table]), default=0) + 1
        self.rows[table].append(row)
        return row["id"]

    def find(self, table: str, **by) -> list[dict]:
        return [r for r in self.rows[table] if all(r.get(k) == v for k, v in by.items())]

    def one(self, table: str, **by) -> dict:
        found = self.find(table, **by)
        if not found:
            raise NotFoundError(f"no {table} with {json.dumps(by)}")
        return found[0]

    def drop(self, table: str, **by) -> None:
        gone = self.find(table, **by)
        self.rows[table] = [r for r in self.rows[table] if r not in gone]


#: What a column refers to; other tables' id, but for the names of columns.
REFERENCES = {
    ("Profile", "last_fingerprint_id"): "Fingerprint.id",
    ("LoadedFile", "profile_id"): "Profile.id",
    ("LoadedFile", "fingerprint_id"): "Fingerprint.id",
    ("Fingerprint", "loaded_file_id"): "LoadedFile.id",
    ("Fingerprint", "profile_id"): "Profile.id",
    ("DatasetColumn", "loaded_file_id"): "LoadedFile.id",
    ("ReconPair", "profile_a_id"): "Profile.id",
    ("ReconPair", "profile_b_id"): "Profile.id",
    ("ColumnMapping", "recon_pair_id"): "ReconPair.id",
    ("JoinKeyStat", "recon_pair_id"): "ReconPair.id",
    ("JoinKeyStat", "file_a_id"): "LoadedFile.id",
    ("JoinKeyStat", "file_b_id"): "LoadedFile.id",
    ("ColumnHierarchy", "loaded_file_id"): "LoadedFile.id",
    ("Run", "recon_pair_id"): "ReconPair.id",
    ("Run", "loaded_file_a_id"): "LoadedFile.id",
    ("Run", "loaded_file_b_id"): "LoadedFile.id",
    ("RunLevelStat", "run_id"): "Run.id",
    ("RunFinding", "run_id"): "Run.id",
    ("RunFinding", "parent_finding_id"): "RunFinding.id",
}


def key_of(table: str, column: str) -> str:
    if column == ("key" if table == "Meta" else "src_row" if table.startswith("Dataset") and table != "DatasetColumn" else "id"):
        return "primary key"
    return f"references {REFERENCES[table, column]}" if (table, column) in REFERENCES else ""


def document(tables: dict[str, DataFrame], most: int = 100_000, samples: int = 5, width: int = 40) -> str:
    """Every table as markdown: columns with keys and references, count, and a few rows of those that aren't large."""
    out = ["# Tables"]
    for name, df in tables.items():
        n = df.count()
        out += ["", f"## {name}", "", f"{n} rows", "", "| column | type | key |", "|---|---|---|", *[f"| {c} | {t} | {key_of(name, c)} |" for c, t in df.dtypes]]
        if 0 < n <= most:
            cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")[:width]
            out += ["", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
            out += ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.select(*[F.col(f"`{c}`") for c in df.columns]).limit(samples).collect()]
    return "\n".join(out) + "\n"
