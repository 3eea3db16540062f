"""The whole surface: ingest, profiles, pairs, hierarchy, suggest, map, reconcile, run, document."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import DelimiterDetectionError, DriftError, HeaderDetectionError, NotFoundError, ReconError, SchemaMismatchError, UnrecognizedFormatError, UsageError
from tallyfold.functions.decimals import format_decimal
from tallyfold.functions.text import norm_column_name, sql_name
from tallyfold.operators import fingerprint as fp
from tallyfold.operators import hierarchy, infer, keys, reconcile
from tallyfold.plans.catalog import Catalog, document, now
from tallyfold.sources import scan
from tallyfold.sources import spec as specs


def parse_mapping(entry: str, role: str) -> reconcile.Mapping:
    """a=b[:level][:raw|smart]; only keys have levels other than 0."""
    a, eq, rest = entry.partition("=")
    b, *more = rest.split(":")
    level, mode = 0, "smart"
    for x in more:
        if x.isdigit():
            level = int(x)
        elif x in ("raw", "smart"):
            mode = x
        else:
            raise UsageError(f"{entry!r}: {x!r} is neither a level nor raw or smart")
    if not eq or not a.strip() or not b.strip():
        raise UsageError(f"{entry!r} is not of the form a=b")
    if role != "key" and level:
        raise UsageError(f"{entry!r}: only keys have levels")
    return reconcile.Mapping(role, level, norm_column_name(a), norm_column_name(b), mode)


#: Bytes beyond which a file is read in splits and never comes to the driver.
LARGE = 64 << 20
FINDING_TYPES = {"run_id": "long", "level": "int", "rows_a": "long", "rows_b": "long"}


def _finding_id(run_id: int, level: Column, key: str) -> Column:
    """The same for one finding however often it is computed, so that children know their parents without another join."""
    return F.md5(F.to_json(F.struct(F.lit(run_id).alias("r"), level.alias("l"), F.col("compare_col").alias("c"), F.col(key).alias("k"))))


class Engine:
    def __init__(self, spark: SparkSession, root: str, large: int = LARGE):
        self.spark, self.root, self.large = spark, root.rstrip("/"), large
        self.catalog = Catalog(spark, root)

    # Files

    def ingest(self, path: str, profile: str | None = None, spec: dict | str | None = None) -> dict:
        """Scan, infer, recognise, check for drift, and only then write; the catalogue's rows come last.

        Folders and files beyond `large` bytes are read in splits (see ingest_large()), but for spreadsheets and specs that
        skip leading lines.
        """
        cat = self.catalog
        size, files = scan.size_of(self.spark, path)
        apart = path.lower().endswith(".xlsx") or (spec is not None and specs.validate(spec).skip_lines > 0)
        if (size > self.large or files > 1) and not apart:
            return self.ingest_large(path, None, profile, spec)
        name, content, sha = scan.read_bytes(self.spark, path)
        if known := cat.find("LoadedFile", sha256=sha):
            return {"status": "already_loaded", "file_id": known[0]["id"]}
        given = specs.validate(spec) if spec is not None else None
        matched = None
        try:
            found = scan.parse(name, content, given)
        except (DelimiterDetectionError, HeaderDetectionError) as e:
            if given:
                raise
            found, matched = self._by_stored_spec(lambda known: scan.parse(name, content, known), name, e)
        return self._take(found, path, len(content), sha, profile, given, matched)

    def ingest_large(self, path: str, delimiter: str | None = None, profile: str | None = None, spec: dict | str | None = None) -> dict:
        """The same for delimited and fixed-width files of any size, a file or a folder, UTF-8 or Windows-1253: no row comes to the driver.

        Rows are numbered by file and split, and quotes must close on their line. Without a delimiter or spec the first lines
        tell it, or the spec of a profile whose files are very like this one.
        """
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        given = specs.validate(spec) if spec is not None else None
        read = lambda known, at: scan.scan_staged(self.spark, path, f"{staging}/{at}", delimiter, known)
        matched = None
        try:
            try:
                found, size, identity = read(given, 0)
            except (DelimiterDetectionError, HeaderDetectionError) as e:
                if given or delimiter:
                    raise
                kept: dict[int, tuple] = {}

                def staged(known: specs.Spec) -> scan.Scanned:
                    out = read(known, len(kept) + 1)
                    kept[id(out[0])] = out
                    return out[0]

                found, matched = self._by_stored_spec(staged, os.path.basename(path.rstrip("/")), e)
                found, size, identity = kept[id(found)]
            if known := self.catalog.find("LoadedFile", sha256=identity):
                return {"status": "already_loaded", "file_id": known[0]["id"]}
            return self._take(found, path, size, identity, profile, given, matched)
        finally:
            fs, p = self.catalog._fs(staging)
            fs.delete(p, True)

    def _take(self, found: scan.Scanned, path: str, size: int, sha: str, profile: str | None, given: specs.Spec | None, matched: int | None) -> dict:
        cat, name = self.catalog, found.name
        typed, columns, names = self._typed(found)
        typed = typed.persist(StorageLevel.DISK_ONLY if found.table is not None else StorageLevel.MEMORY_AND_DISK)
        try:
            rows = found.size
            print_ = fp.compute(typed, found.encoding, columns, rows, cat.salt)
            routing, profile_id, suggestions = self._route(print_, profile, matched)
            drift = {"hard": [], "soft": []}
            if profile_id and (last := self._last_print(profile_id)):
                drift = fp.drift(last, print_, self._mapped(profile_id))
                if drift["hard"]:
                    raise DriftError("; ".join(drift["hard"]))
            file_id = max((r["id"] for r in cat.rows["LoadedFile"]), default=0) + 1
            table = f"{self.root}/datasets/Dataset{file_id}"
            typed.write.mode("overwrite").parquet(table)
            deps = hierarchy.detect(typed, {c.name: c.distinct for c in columns if c.type != "decimal"})
        finally:
            typed.unpersist()
        if routing == "created_new_profile" or routing == "attached_explicit" and not profile_id:
            profile_id = cat.add("Profile", name=self._free_name(profile or os.path.splitext(name)[0]), created_at=now())
        file_id = cat.add("LoadedFile", file_name=name, absolute_path=path, size_bytes=size, sha256=sha, format=found.format, encoding=found.encoding, loaded_at=now(), row_count=rows, dataset_table=table, profile_id=profile_id)
        for i, (c, raw) in enumerate(zip(columns, found.header, strict=True)):
            cat.add("DatasetColumn", loaded_file_id=file_id, position=i, name_raw=raw, name_norm=c.name, sql_name=names[i], inferred_type=c.type, number_format=c.format, null_count=c.nulls, distinct_count=c.distinct)
        print_id = cat.add("Fingerprint", loaded_file_id=file_id, profile_id=profile_id, fingerprint_json=json.dumps(print_.to_dict(), sort_keys=True), drift_warnings_json=json.dumps(drift["soft"]), computed_at=now())
        cat.one("LoadedFile", id=file_id)["fingerprint_id"] = print_id
        if profile_id:
            p = cat.one("Profile", id=profile_id)
            p["last_fingerprint_id"] = print_id
            if given and not p.get("parse_spec_json"):
                p["parse_spec_json"] = given.to_json()
        for d in deps:
            cat.add("ColumnHierarchy", loaded_file_id=file_id, parent_name=d.parent, child_name=d.child, parent_distinct=d.parent_distinct, child_distinct=d.child_distinct, consistency=d.consistency, kind=d.kind, computed_at=now())
        cat.save("Profile", "DatasetColumn", "Fingerprint", "ColumnHierarchy", "LoadedFile")
        return {"status": "loaded", "file_id": file_id, "routing": routing, "profile": profile_id and cat.one("Profile", id=profile_id)["name"], "suggestions": suggestions, "drift": drift, "rows": rows}

    def _typed(self, found: scan.Scanned) -> tuple[DataFrame, list[infer.Column], list[str]]:
        norm = [norm_column_name(h) for h in found.header]
        if len(set(norm)) < len(norm):
            raise HeaderDetectionError(f"{found.name}: two columns have one name but for white space")
        taken = {"src_row"}
        names = [sql_name(h, taken) for h in found.header]
        rounding, hint = found.format == "xlsx", "greek" if found.encoding == "cp1253" else "standard"
        forced = {norm_column_name(k): v for k, v in found.forced.items()}
        raw = infer.trimmed(found.frame(self.spark, norm), norm)
        columns = infer.infer(raw, norm, hint, rounding, forced)
        typed = infer.canonical(raw, columns, rounding)
        stats = {r["col"]: r for r in infer.column_stats(typed, norm).collect()} if norm else {}
        for c in columns:
            c.nulls, c.distinct = (stats[c.name].nulls, stats[c.name].distinct) if c.name in stats else (0, 0)
        return typed, columns, names

    def _by_stored_spec(self, read: Callable[[specs.Spec], scan.Scanned], name: str, why: ReconError) -> tuple[scan.Scanned, int]:
        """The one profile whose stored spec reads the file into something very like its last file."""
        fits = []
        for p in self.catalog.rows["Profile"]:
            last = self._last_print(p["id"])
            if not p.get("parse_spec_json") or not last:
                continue
            try:
                found = read(specs.validate(p["parse_spec_json"]))
                typed, columns, _ = self._typed(found)
            except ReconError:  # this spec doesn't read it; the others may
                continue
            if fp.similarity(fp.compute(typed, found.encoding, columns, found.size, self.catalog.salt), last)["score"] >= fp.AUTO_ATTACH:
                fits.append((found, p["id"]))
        if len(fits) > 1:
            raise UnrecognizedFormatError(f"{name}: the specs of several profiles fit")
        if not fits:
            raise why
        return fits[0]

    def _last_print(self, profile_id: int) -> fp.Fingerprint | None:
        p = self.catalog.one("Profile", id=profile_id)
        if not p.get("last_fingerprint_id"):
            return None
        return fp.Fingerprint(**json.loads(self.catalog.one("Fingerprint", id=p["last_fingerprint_id"])["fingerprint_json"]))

    def _route(self, print_: fp.Fingerprint, explicit: str | None, matched: int | None) -> tuple[str, int | None, list[dict]]:
        if explicit:
            known = self.catalog.find("Profile", name=explicit)
            return "attached_explicit", known[0]["id"] if known else None, []
        if matched:
            return "attached_existing", matched, []
        scored = sorted(((fp.similarity(print_, last)["score"], p) for p in self.catalog.rows["Profile"] if (last := self._last_print(p["id"]))), key=lambda x: -x[0])
        if scored and scored[0][0] >= fp.AUTO_ATTACH:
            return "attached_existing", scored[0][1]["id"], []
        if scored and scored[0][0] >= fp.SUGGEST:
            return "unattached_suggest", None, [{"profile": p["name"], "score": round(s, 3)} for s, p in scored if s >= fp.SUGGEST][:5]
        return "created_new_profile", None, []

    def _free_name(self, stem: str) -> str:
        name, k = stem, 2
        while self.catalog.find("Profile", name=name):
            name, k = f"{stem}-{k}", k + 1
        return name

    def _mapped(self, profile_id: int) -> set[str]:
        """Columns of this profile that any pair maps, on either side."""
        out = set()
        for p in self.catalog.rows["ReconPair"]:
            for m in self.catalog.find("ColumnMapping", recon_pair_id=p["id"]):
                out |= ({m["col_a"]} if p["profile_a_id"] == profile_id else set()) | ({m["col_b"]} if p["profile_b_id"] == profile_id else set())
        return out

    # Profiles and pairs

    def profiles(self) -> list[dict]:
        return [p | {"files": len(self.catalog.find("LoadedFile", profile_id=p["id"]))} for p in self.catalog.rows["Profile"]]

    def profile(self, name: str) -> dict:
        p = self.catalog.one("Profile", name=name)
        return p | {"files": self.catalog.find("LoadedFile", profile_id=p["id"])}

    def attach(self, file_id: int, name: str) -> dict:
        cat = self.catalog
        f = cat.one("LoadedFile", id=file_id)
        print_ = cat.one("Fingerprint", id=f["fingerprint_id"])
        known = cat.find("Profile", name=name)
        drift = {"hard": [], "soft": []}
        if known and (last := self._last_print(known[0]["id"])):
            drift = fp.drift(last, fp.Fingerprint(**json.loads(print_["fingerprint_json"])), self._mapped(known[0]["id"]))
            if drift["hard"]:
                raise DriftError("; ".join(drift["hard"]))
        pid = known[0]["id"] if known else cat.add("Profile", name=name, created_at=now())
        cat.one("Profile", id=pid)["last_fingerprint_id"] = print_["id"]
        f["profile_id"] = print_["profile_id"] = pid
        cat.save("Profile", "Fingerprint", "LoadedFile")
        return drift

    def create_pair(self, name: str, profile_a: str, profile_b: str) -> int:
        if self.catalog.find("ReconPair", name=name):
            raise UsageError(f"there is a pair {name!r} already")
        pid = self.catalog.add("ReconPair", name=name, profile_a_id=self.catalog.one("Profile", name=profile_a)["id"], profile_b_id=self.catalog.one("Profile", name=profile_b)["id"], created_at=now())
        self.catalog.save("ReconPair")
        return pid

    def pairs(self) -> list[dict]:
        name = lambda i: self.catalog.one("Profile", id=i)["name"]
        return [p | {"profile_a": name(p["profile_a_id"]), "profile_b": name(p["profile_b_id"]), "mappings": len(self.catalog.find("ColumnMapping", recon_pair_id=p["id"]))} for p in self.catalog.rows["ReconPair"]]

    def map(self, pair: str, keys_: list[str] = (), compares: list[str] = (), displays: list[str] = (), clear: bool = False) -> list[dict]:
        p = self.catalog.one("ReconPair", name=pair)
        entries = [parse_mapping(e, r) for r, es in (("key", keys_), ("compare", compares), ("display", displays)) for e in es]
        self._record(p["id"], entries, clear)
        return self.catalog.find("ColumnMapping", recon_pair_id=p["id"])

    def _record(self, pair_id: int, entries: list[reconcile.Mapping], clear: bool) -> None:
        if clear:
            self.catalog.drop("ColumnMapping", recon_pair_id=pair_id)
        for m in entries:
            own = {"recon_pair_id": pair_id, "role": m.role, "level": m.level, "col_a": m.col_a, "col_b": m.col_b}
            if not self.catalog.find("ColumnMapping", **own):
                self.catalog.add("ColumnMapping", **own, norm_mode=m.mode)
        self.catalog.save("ColumnMapping")

    # Analysis

    def dataset(self, file_id: int) -> DataFrame:
        return self.spark.read.parquet(self.catalog.one("LoadedFile", id=file_id)["dataset_table"])

    def columns(self, file_id: int) -> list[infer.Column]:
        rows = sorted(self.catalog.find("DatasetColumn", loaded_file_id=file_id), key=lambda r: r["position"])
        return [infer.Column(r["name_norm"], r["inferred_type"], r["number_format"], r["null_count"], r["distinct_count"]) for r in rows]

    def hierarchy(self, file_id: int) -> dict:
        deps = self._deps(file_id)
        return {"chains": hierarchy.chains(deps), "dependencies": [asdict(d) for d in deps]}

    def _deps(self, file_id: int) -> list[hierarchy.Dependency]:
        self.catalog.one("LoadedFile", id=file_id)
        return [hierarchy.Dependency(r["parent_name"], r["child_name"], r["parent_distinct"], r["child_distinct"], r["consistency"], r["kind"]) for r in self.catalog.find("ColumnHierarchy", loaded_file_id=file_id)]

    def _files(self, p: dict, a: int | None, b: int | None) -> tuple[int, int]:
        def latest(profile_id: int) -> int:
            ids = [f["id"] for f in self.catalog.find("LoadedFile", profile_id=profile_id)]
            if not ids:
                raise NotFoundError("a profile has no file")
            return max(ids)

        return a or latest(p["profile_a_id"]), b or latest(p["profile_b_id"])

    def suggest(self, pair: str, a: int | None = None, b: int | None = None) -> dict:
        p = self.catalog.one("ReconPair", name=pair)
        fa, fb = self._files(p, a, b)
        found, compare = keys.suggest(self.dataset(fa), self.dataset(fb), self.columns(fa), self.columns(fb))
        nulls = [{r["name_norm"]: keys.round3(r["null_count"] / max(1, self.catalog.one("LoadedFile", id=f)["row_count"])) for r in self.catalog.find("DatasetColumn", loaded_file_id=f)} for f in (fa, fb)]
        for c in found:
            self.catalog.add("JoinKeyStat", recon_pair_id=p["id"], file_a_id=fa, file_b_id=fb, col_a=c.col_a, col_b=c.col_b, uniqueness_a=c.unique_a, uniqueness_b=c.unique_b, overlap_ratio=c.overlap, null_rate_a=nulls[0][c.col_a], null_rate_b=nulls[1][c.col_b], computed_at=now())
        self.catalog.save("JoinKeyStat")
        levels = hierarchy.propose_levels(self._deps(fa), self._deps(fb), [(c.col_a, c.col_b) for c in found])
        return {"keys": [asdict(c) for c in found], "compares": [{"col_a": x, "col_b": y, "name_sim": s} for x, y, s in compare], "levels": levels}

    def reconcile(self, pair: str, a: int | None = None, b: int | None = None, tolerance: str = "0.01", m2m_cap: int = 10_000, lineage_rows: int | None = None) -> dict:
        cat = self.catalog
        p = cat.one("ReconPair", name=pair)
        fa, fb = self._files(p, a, b)
        maps = [reconcile.Mapping(m["role"], m["level"], m["col_a"], m["col_b"], m["norm_mode"]) for m in cat.find("ColumnMapping", recon_pair_id=p["id"])]
        x, y = self.dataset(fa), self.dataset(fb)
        policy = reconcile.Policy(tolerance, m2m_cap, lineage_rows=lineage_rows)
        reconcile.check(x, y, maps)
        # The run stands in the catalogue before its work: one that fails keeps its number and never gets an end.
        run_uuid = str(uuid.uuid4())
        run_id = cat.add("Run", run_uuid=run_uuid, recon_pair_id=p["id"], loaded_file_a_id=fa, loaded_file_b_id=fb, config_json=json.dumps({"tolerance": tolerance, "m2m_cap": m2m_cap, "mappings": [asdict(m) for m in maps]}), started_at=now(), total_findings=0)
        cat.save("Run")
        every = reconcile.reconcile(x, y, maps, policy, all_buckets=True, keyed=True).persist()
        try:
            with reconcile.named_errors():
                stats = [r.asDict() for r in reconcile.level_stats(every).orderBy("level").collect()]
            kept = reconcile.with_lineage(every.filter("bucket <> 'MATCH'"), x, y, maps, policy.lineage_rows)
            kept = kept.withColumn("lineage_json", reconcile.lineage_json()).drop("lineage_a", "lineage_b")
            if "note" not in kept.columns:
                kept = kept.withColumn("note", F.lit(None).cast("string"))
            kept.withColumns({"run_id": F.lit(run_id), "id": _finding_id(run_id, F.col("level"), "key_json"), "parent_finding_id": F.when(F.col("level") > 0, _finding_id(run_id, F.col("level") - 1, "parent_json"))}).write.mode("overwrite").partitionBy("level").parquet(f"{self.root}/findings/run_id={run_id}")
            high = every.filter("severity = 'high'").count()
        finally:
            every.unpersist()
        total = sum(s["only_a"] + s["only_b"] + s["differ"] for s in stats if s["level"] == 0)
        for s in stats:
            cat.add("RunLevelStat", run_id=run_id, **s)
        cat.one("Run", id=run_id).update(finished_at=now(), total_findings=total)
        cat.save("RunLevelStat", "Run")
        return {"pair": pair, "run_id": run_id, "run_uuid": run_uuid, "tolerance": tolerance, "levels": stats, "total_findings": total, "high_severity": high}

    def findings(self, run_id: int) -> DataFrame:
        self.catalog.one("Run", id=run_id)
        return self.spark.read.parquet(f"{self.root}/findings/run_id={run_id}")

    def lineage(self, run_id: int) -> DataFrame:
        """level, norm_keys, side and src_row of all source rows of a run's findings, however many a key has."""
        r = self.catalog.one("Run", id=run_id)
        maps = [reconcile.Mapping(**m) for m in json.loads(r["config_json"])["mappings"]]
        return reconcile.lineage_rows(self.findings(run_id), self.dataset(r["loaded_file_a_id"]), self.dataset(r["loaded_file_b_id"]), maps)

    def run_findings(self) -> DataFrame:
        """Findings of all runs, amounts as exact decimal texts; a child names its parent by id."""
        amounts = {f"{n}_micros": format_decimal(F.col(n)) for n in ("value_a", "value_b", "delta")}
        shown = ["id", "run_id", "parent_finding_id", "level", "bucket", "key_json", "compare_col", *amounts, "rows_a", "rows_b", "severity", "note", "lineage_json"]
        done = [r for r in self.catalog.rows["Run"] if r.get("finished_at")]
        if not done:
            text = ", ".join(f"{c} {FINDING_TYPES.get(c, 'string')}" for c in shown)
            return self.spark.createDataFrame([], text)
        every = [self.findings(r["id"]).withColumns(amounts).select(*shown) for r in done]
        return reduce(DataFrame.union, every)

    def register(self) -> list[str]:
        """Names of temporary views over all that is kept: the catalogue, RunFinding, and Dataset1, Dataset2 and so on."""
        views = {t: self.catalog.table(t) for t in self.catalog.rows} | {"RunFinding": self.run_findings()}
        views |= {f"Dataset{f['id']}": self.dataset(f["id"]) for f in self.catalog.rows["LoadedFile"]}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return list(views)

    def sql(self, query: str) -> DataFrame:
        """The caller's own query over those views."""
        self.register()
        return self.spark.sql(query)

    def run(self, path_a: str, path_b: str, pair: str | None = None, auto: bool = False, profile_a: str | None = None, profile_b: str | None = None, tolerance: str = "0.01", m2m_cap: int = 10_000) -> dict:
        """Both files in, and reconciled as far as no decision is needed. Each file stays even if the other fails."""
        cat = self.catalog
        a, b = self.ingest(path_a, profile_a), self.ingest(path_b, profile_b)
        sides = [cat.one("LoadedFile", id=x["file_id"])["profile_id"] for x in (a, b)]
        if None in sides:
            return {"status": "decisions_needed", "reasons": [f"side {s} has no profile" for s, p in zip("AB", sides, strict=True) if p is None], "a": a, "b": b}
        if pair:
            p = cat.one("ReconPair", name=pair)
        else:
            known = cat.find("ReconPair", profile_a_id=sides[0], profile_b_id=sides[1])
            if not known:
                names = [cat.one("Profile", id=s)["name"] for s in sides]
                self.create_pair(f"{names[0]} vs {names[1]}", *names)
            p = cat.one("ReconPair", profile_a_id=sides[0], profile_b_id=sides[1])
        fa, fb = a["file_id"], b["file_id"]

        def ready() -> bool:
            own = cat.find("ColumnMapping", recon_pair_id=p["id"])
            return any(m["role"] == "key" and m["level"] == 0 for m in own) and any(m["role"] == "compare" for m in own)

        warnings: list[str] = []
        if not ready() and auto:
            picked, warnings = keys.auto_pick(self.dataset(fa), self.dataset(fb), self.columns(fa), self.columns(fb))
            if {"key", "compare"} <= {m.role for m in picked}:
                self._record(p["id"], picked, False)
        if not ready():
            return {"status": "decisions_needed", "reasons": ["the pair has no level-0 key or nothing to compare"], "suggest": self.suggest(p["name"], fa, fb), "warnings": warnings}
        return {"status": "completed", "warnings": warnings} | self.reconcile(p["name"], fa, fb, tolerance, m2m_cap)

    def document(self) -> str:
        tables = {t: self.catalog.table(t) for t in self.catalog.rows}
        tables |= {f"Dataset{f['id']}": self.dataset(f["id"]) for f in self.catalog.rows["LoadedFile"]}
        tables["RunFinding"] = self.run_findings()
        return document(tables)


__all__ = ["Engine", "SchemaMismatchError", "parse_mapping"]
