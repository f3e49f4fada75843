"""The engine as an object: datasets, profiles, models, queries and findings."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gleaner.model import ColumnProfile, Event, Insight, Query, QueryResult, SemanticModel, revive
from gleaner.operators.dataset import Dataset
from gleaner.plans import agent, query, semantic
from gleaner.sources import samples, text

CELL, SHOWN = 40, 60


def short_id(name: str) -> str:
    slug = re.sub(r"[^\w]+", "-", name.lower()).strip("-")[:24] or "dataset"
    return f"{slug}-{hashlib.sha256(uuid.uuid4().bytes).hexdigest()[:6]}"


class Engine:
    """A catalogue of datasets. With ``home`` (a folder in any store that Spark
    writes to) typed tables and their models outlive the session."""

    def __init__(self, spark: SparkSession, home: str | None = None, planner: Callable[[Dataset, str], dict] | None = None, narrator: Callable[[Dataset, list[Insight]], str | None] | None = None):
        self.spark, self.home, self.planner, self.narrator = spark, home.rstrip("/") if home else None, planner, narrator
        self.datasets: dict[str, Dataset] = {}
        self.insights: dict[str, list[Insight]] = {}
        self._saved: dict[str, float] = {}

    # Ingest

    def upload_dataset(self, content: str, name: str = "dataset", format: str | None = None, max_rows: int | None = None) -> str:
        """Text of at most 64 MiB: CSV, TSV, JSON or one JSON value a line."""
        if len(content.encode()) > text.MAX_BYTES:
            raise text.IngestError("The text is larger than 64 MiB; read it from a file.")
        parsed = text.parse(content, format)
        if not parsed.columns:
            raise text.IngestError("There are no columns.")
        if not parsed.rows:
            raise text.IngestError("There are no rows.")
        if max_rows and len(parsed.rows) > max_rows:
            parsed.warnings.append(f"Only the first {max_rows} of {len(parsed.rows)} rows were kept.")
            parsed.rows = parsed.rows[:max_rows]
        key = self._register(Dataset(name, text.to_frame(self.spark, parsed), warnings=parsed.warnings, source="upload"))
        if self.home:  # the text as it came
            self._write(f"{self.home}/{key}.raw", content.encode())
        return key

    def load_delimited(self, path: str, name: str | None = None, **options) -> str:
        df, warnings = text.read_delimited(self.spark, path, **options)
        return self._register(Dataset(name or path.rsplit("/", 1)[-1], df, warnings=warnings, source="file"))

    def load_json(self, path: str, name: str | None = None, multi_line: bool = False) -> str:
        return self._register(Dataset(name or path.rsplit("/", 1)[-1], text.read_json(self.spark, path, multi_line), source="file"))

    def load_parquet(self, path: str, name: str | None = None) -> str:
        return self.add_frame(self.spark.read.parquet(path), name or path.rsplit("/", 1)[-1])

    def add_frame(self, df: DataFrame, name: str, model: SemanticModel | None = None) -> str:
        return self._register(Dataset(name, df, model=model or SemanticModel()))

    def load_sample(self, name: str) -> str:
        if name not in samples.SAMPLES:
            raise semantic.QueryError(f"There is no sample '{name}'.", list(samples.SAMPLES))
        return self._register(Dataset(name, samples.SAMPLES[name](self.spark), source="sample"))

    def _register(self, ds: Dataset) -> str:
        key = short_id(ds.name)
        agent.prepare(ds)
        if ds.kinds:
            ds = ds.materialised(f"{self.home}/{key}.parquet" if self.home else None)
        elif self.home:
            ds = ds.materialised(f"{self.home}/{key}.parquet")
        self.datasets[key] = ds
        self._save(key)
        return key

    # Persistence

    def _store(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, path: str, data: bytes) -> None:
        p, store = self._store(path)
        out = store.create(p, True)
        out.write(bytearray(data))
        out.close()

    def _save(self, key: str) -> None:
        if not self.home:
            return
        ds = self.datasets[key]
        meta = {"name": ds.name, "source": ds.source, "kinds": ds.kinds, "warnings": ds.warnings, "rows": ds.rows, "model": ds.model.to_dict(), "insights": [asdict(x) for x in self.insights.get(key, [])], "profiles": [asdict(x) for x in ds.profiles], "saved": self._saved.setdefault(key, time.time())}
        self._write(f"{self.home}/{key}.json", json.dumps(meta, ensure_ascii=False).encode())

    def reload(self) -> list[str]:
        """Datasets saved under ``home``, oldest first, with models, profiles and findings."""
        root, store = self._store(self.home)
        keys = [s.getPath().getName()[:-5] for s in store.listStatus(root) if s.getPath().getName().endswith(".json")] if store.exists(root) else []
        metas = {key: json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.home}/{key}.json").collect())) for key in keys}
        keys = sorted(keys, key=lambda k: (metas[k].get("saved", 0.0), k))
        for key in keys:
            meta = metas[key]
            df = self.spark.read.parquet(f"{self.home}/{key}.parquet")
            self.datasets[key] = Dataset(meta["name"], df, meta["kinds"], {}, SemanticModel.from_dict(meta["model"]), [revive(ColumnProfile, x) for x in meta.get("profiles", [])], meta["warnings"], meta["rows"], meta["source"])
            self.insights[key] = [revive(Insight, x) for x in meta.get("insights", [])]
            self._saved[key] = meta.get("saved", 0.0)
        return keys

    def delete_dataset(self, key: str) -> bool:
        found = self.datasets.pop(key, None)
        self.insights.pop(key, None)
        if found is not None:
            found.df.unpersist()
        if self.home:
            for kind in ("json", "raw", "parquet"):
                path, store = self._store(f"{self.home}/{key}.{kind}")
                store.delete(path, True)
        return found is not None

    # Catalogue

    def dataset(self, key: str) -> Dataset:
        if key not in self.datasets:
            raise semantic.QueryError(f"There is no dataset '{key}'.", semantic.suggest(key, list(self.datasets)))
        return self.datasets[key]

    def list_datasets(self) -> list[dict[str, Any]]:
        """Newest first."""
        return [{"id": k, "name": d.name, "rows": d.count(), "columns": len(d.columns), "source": d.source, "reviewed": d.model.reviewed} for k, d in reversed(self.datasets.items())]

    def describe(self, key: str) -> dict[str, Any]:
        """Everything but the rows, ready for JSON."""
        d = self.dataset(key)
        return {"id": key, "name": d.name, "rows": d.count(), "columns": d.columns, "kinds": {c: d.kind(c) for c in d.columns}, "warnings": d.warnings, "model": d.model.to_dict()}

    def get_semantic_model(self, key: str) -> SemanticModel:
        return self.dataset(key).model

    def describe_semantic_model(self, key: str) -> str:
        return semantic.describe_model(self.dataset(key).model)

    def update_semantic_model(self, key: str, measures: dict[str, dict] | None = None, reviewed: bool | None = None, grain_description: str | None = None) -> list[str]:
        missed = semantic.update(self.dataset(key).model, measures or {}, reviewed, grain_description)
        self._save(key)
        return missed

    def profile_dataset(self, key: str, columns: list[str] | None = None) -> list[ColumnProfile]:
        d = self.dataset(key)
        if not d.profiles:
            from gleaner.operators.profile import profile

            d.profiles = profile(d)
            self._save(key)
        return [p for p in d.profiles if columns is None or p.name in columns]

    # Questions

    def query_data(self, key: str, q: Query) -> QueryResult:
        return query.run(self.dataset(key), q)

    def query_frame(self, key: str, q: Query) -> DataFrame:
        """The query as a lazy DataFrame, with no limit but the query's own."""
        return query.Plan(self.dataset(key), q).whole()

    def ask(self, key: str, question: str) -> QueryResult:
        """A question in words, by the planner that the engine was given."""
        if self.planner is None:
            raise RuntimeError("This engine has no planner: give one, or use query_data.")
        d = self.dataset(key)
        p = self.planner(d, question)
        return query.run(d, query.from_plan(p["metrics"], p.get("group_by", []), p.get("time_grain"), p.get("filters", []), p.get("top"), d))

    def analyze_events(self, key: str, focus: str = "", **options) -> Iterator[Event]:
        """Events of an insight run; its findings are kept, the last of an id wins."""
        for e in agent.run(self.dataset(key), focus, narrate=self.narrator, **options):
            if e.phase == "done":
                self.insights[key] = list({x.id: x for x in [*self.insights.get(key, []), *e.payload.insights]}.values())
                self._save(key)
            yield e

    def analyze_dataset(self, key: str, focus: str = "", **options) -> agent.Summary:
        return list(self.analyze_events(key, focus, **options))[-1].payload

    def get_insights(self, key: str) -> list[Insight]:
        self.dataset(key)
        return self.insights.get(key, [])

    def insight_frame(self, key: str) -> DataFrame:
        return agent.insight_frame(self.spark, self.get_insights(key))


# Rendering


def render_table(r: QueryResult) -> str:
    """Fixed width, cells of at most 40 characters, the first 60 rows."""
    cells = [[("" if v is None else str(v))[:CELL] for v in row] for row in [r.columns, *r.rows[:SHOWN]]]
    widths = [max(len(row[i]) for row in cells) for i in range(len(r.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    lines.insert(1, "  ".join("-" * w for w in widths))
    if len(r.rows) > SHOWN:
        lines.append(f"... {len(r.rows) - SHOWN} more rows")
    if r.truncated:
        lines.append("The result was cut at the limit.")
    return "\n".join([*lines, "", r.explanation])


def render_report(s: agent.Summary) -> str:
    out = [s.headline, ""]
    for i, x in enumerate(s.insights, 1):
        out += [f"{i}. [{x.kind}] {x.title} (confidence {x.confidence:.0%}, impact {x.impact:.0%})", f"   {x.narrative}"]
        out += [f"   - {a}: {b}" for a, b in x.evidence.facts] + [f"   trace: {t}" for t in x.trace] + [f"   caveat: {c}" for c in x.caveats] + [f"   next: {n.action}" for n in x.next_steps]
    return "\n".join([*out, "", "Plan:", *(f"- [{n.type}] {n.action}: {n.rationale}" for n in s.steps)])


def event_frame(e: Event) -> str:
    """One server-sent frame."""
    return f"data: {json.dumps({'phase': e.phase, 'message': e.message, 'progress': e.progress}, ensure_ascii=False)}\n\n"


def to_csv(columns: list[str], rows: list[tuple]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
