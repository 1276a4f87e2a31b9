"""Sidecar files beside a document: its concept spaces and projections with a content hash, and the state file with facts
and proofs that other programs keep too.

One document's files are small and are written by the driver; corpora are written as tables (see ``stores``).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable, Mapping
from pathlib import Path

from ..functions.ids import canonical_json

SUFFIX = ".conspectus.json"
VOLATILE = frozenset({"created_at", "content_hash", "source_mtime", "elapsed_seconds"})
FACT = "CES_BUILT"
ALGORITHM = "sha256"


def _written(path: Path, value: Mapping, **how) -> Path:
    """Whole or not at all: a temporary file beside it takes the file's place."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.tmp")
    part.write_text(json.dumps(value, indent=2, default=str, **how) + "\n", encoding="utf-8")
    part.replace(path)
    return path


def sidecar_path(source: str | Path, output: str | Path | None = None) -> Path:
    """The path asked for, or one beside the source; ``.json`` is not doubled."""
    if output:
        return Path(output)
    source = Path(source)
    return source.with_name(source.name.removesuffix(".json") + SUFFIX)


def content_hash(payload: Mapping) -> str:
    """sha256 of the canonical form without what changes from run to run."""
    return hashlib.sha256(canonical_json(payload, VOLATILE).encode()).hexdigest()


def build_payload(source: str | None, spaces: Mapping[str, Mapping], projections: Iterable[Mapping], skipped: Iterable[Mapping] = (), meta: Mapping | None = None) -> dict:
    """spaces: model to {"concepts": [...], ...}."""
    payload = {"format": "conspectus", "format_version": 1, "source": source, "meta": dict(meta or {}), "concept_spaces": {m: dict(s) for m, s in spaces.items()}, "projections": list(projections), "skipped": list(skipped)}
    return payload | {"content_hash": content_hash(payload)}


def write_sidecar(payload: Mapping, path: str | Path) -> Path:
    return _written(Path(path), payload, ensure_ascii=False)


def read_sidecar(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def verify_sidecar(path: str | Path) -> tuple[bool, str, str]:
    """(whether they agree, the stored hash, the computed one)."""
    payload = read_sidecar(path)
    stored, computed = str(payload.get("content_hash", "")), content_hash(payload)
    return stored == computed, stored, computed


def resolve_concept(payload: Mapping, projection: Mapping, concept_id: str) -> dict | None:
    """The concept in the space of the projection's model."""
    space = payload.get("concept_spaces", {}).get(projection.get("embedding_model", ""), {})
    return next((c for c in space.get("concepts", ()) if c.get("concept_id") == concept_id), None)


def file_hash(path: str | Path) -> str | None:
    """``sha256:...`` of a file's bytes, null if it cannot be read."""
    try:
        return f"{ALGORITHM}:{hashlib.sha256(Path(path).read_bytes()).hexdigest()}"
    except OSError:
        return None


def params_hash(params: Mapping | None) -> str:
    """Hash of parameters, whatever their order."""
    text = json.dumps(dict(params or {}), sort_keys=True, ensure_ascii=False, default=str)
    return f"{ALGORITHM}:{hashlib.sha256(text.encode()).hexdigest()}"


def make_proof(produced_by: str, inputs: Iterable = (), params: Mapping | None = None) -> dict:
    """What was made by whom from which bytes; unreadable inputs are left out."""
    hashes = {str(p): file_hash(p) for p in inputs}
    return {"produced_by": produced_by, "inputs": {p: h for p, h in hashes.items() if h}, "params_hash": params_hash(params), "algo": ALGORITHM, "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}


def verify_proof(proof: Mapping) -> bool:
    """Whether every input still has its hash; hashes of another algorithm are not judged."""
    own = {p: h for p, h in (proof.get("inputs") or {}).items() if str(h).startswith(f"{ALGORITHM}:")}
    return all(file_hash(p) == h for p, h in own.items())


def state_path(document: str | Path) -> Path:
    """The state file of a document's folder: inside it, or beside it where an older one stands."""
    folder = Path(document).resolve().parent
    inside, beside = folder / f"{folder.name}.drill.json", folder.parent / f"{folder.name}.json"
    return beside if beside.exists() and not inside.exists() else inside


def read_state(path: str | Path) -> dict:
    """The state; empty if there is none or it is damaged."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def register(document: str | Path, artefact: str | Path, produced_by: str = "conspectus", params: Mapping | None = None, evidence: Mapping | None = None, fact: str = FACT, state: str | Path | None = None) -> Path:
    """Adds a fact, its proof and evidence to the state; all else in it stays."""
    target = Path(state) if state else state_path(document)
    now = read_state(target)
    facts, known = now.get("facts", []), now.get("capabilities", {})
    shown = {k if str(k).startswith("ces_") else f"ces_{k}": v for k, v in (evidence or {}).items()}
    now |= {
        "facts": facts if fact in facts else [*facts, fact],
        "capabilities": {**known, fact: make_proof(produced_by, [document], params)},
        "evidence": {**now.get("evidence", {}), "ces_path": str(artefact), **shown},
    }
    return _written(target, now, ensure_ascii=False)


def has_fact(document: str | Path, fact: str = FACT, state: str | Path | None = None) -> bool:
    return fact in read_state(state or state_path(document)).get("facts", [])


def capability_valid(document: str | Path, fact: str = FACT, state: str | Path | None = None) -> bool:
    """Whether the fact is there and its proof holds; one without proof is trusted."""
    now = read_state(state or state_path(document))
    proof = now.get("capabilities", {}).get(fact)
    return fact in now.get("facts", []) and (not proof or verify_proof(proof))


def artefact_path(document: str | Path, output: str | Path | None = None) -> Path:
    """Where a document's tree and summaries are kept: in a folder beside it, or where asked for."""
    return Path(output) if output else Path(document).resolve().parent / "drill" / "model.ces.json"


def tree_payload(tree, run, document: str | Path, doc_id: str, created_at: str = "") -> dict:
    """One document's markers with their units, summaries, statistics and the fingerprint of its file, under a content hash."""
    own = lambda rows, *order: [r.asDict(recursive=True) for r in rows.where(rows["doc_id"] == doc_id).drop("doc_id").orderBy(*order).collect()]  # noqa: E731  of one document
    data = Path(document)
    payload = {
        "format": "conspectus-tree", "format_version": 1, "created_at": created_at,
        "source": {"path": str(document), "bytes": data.stat().st_size if data.exists() else None, "sha256": file_hash(document)},
        "stats": own(tree.stats(), "markers"), "markers": own(tree.markers, "flow_index", "marker_id"), "units": own(tree.units, "flow_index", "unit_id"),
        "skipped": own(tree.skipped, "object_id"), "summaries": own(run.summaries, "span_id"), "model": run.model,
    }
    return payload | {"content_hash": content_hash(payload)}


def save_artefact(payload: Mapping, document: str | Path, output: str | Path | None = None, params: Mapping | None = None, registering: bool = True) -> Path:
    """Writes an artefact and states in the document's state file that it was built, from which bytes and with what."""
    path = write_sidecar(payload, artefact_path(document, output))
    if registering:
        register(document, path, params=params, evidence={"content_hash": payload["content_hash"], "markers": len(payload["markers"])})
    return path


def read_artefact(document: str | Path, output: str | Path | None = None) -> dict | None:
    """The artefact; null if there is none or it is damaged."""
    return read_state(artefact_path(document, output)) or None


def artefact_stale(document: str | Path, output: str | Path | None = None) -> bool | None:
    """Whether the document has changed since; null without an artefact."""
    found = read_artefact(document, output)
    return None if found is None else found.get("source", {}).get("sha256") != file_hash(document)
