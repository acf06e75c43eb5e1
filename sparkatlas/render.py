"""Result rows as lines of text. Row counts are bounded by the caller's limits."""

from __future__ import annotations

from .api import CodeIndex

SIGNATURE = 100


def _short(text: str | None) -> str:
    text = text or ""
    return text if len(text) <= SIGNATURE else text[:SIGNATURE] + "…"


def definitions(rows) -> list[str]:
    return [f"  {r.path}:{r.start_line}-{r.end_line}  {r.qualified_name}  ({r.kind})  {_short(r.signature)}" for r in rows]


def callers(rows) -> list[str]:
    return [f"  [{r.depth}] {r.qualified_name}  {r.path}:{r.via_line}  ({r.via_conf:.2f})" for r in rows]


def calls(rows) -> list[str]:
    return [f"  {r.line}: {r.dst_name} -> {f'{r.dst_qualified}  {r.dst_path}' if r.dst_qualified else 'unresolved'}  ({r.resolution} {r.confidence:.2f})" for r in rows]


def refs(rows) -> list[str]:
    return [f"  {r.path}:{r.line}  in {r.qualified_name}  ({r.resolution} {r.confidence:.2f})" for r in rows]


def partners(rows) -> list[str]:
    return [f"  {r.partner}  {r.both_count} commits  confidence {r.confidence:.0%}  lift {r.lift:.1f}" for r in rows]


def hot(rows) -> list[str]:
    return [f"  {r.path}  {r.change_count} commits  last {(r.last_changed or '')[:10]}  {r.top_authors}" for r in rows]


def stats(index: CodeIndex) -> list[str]:
    parts = {n: df.collect() for n, df in index.stats().items()}
    meta = {r.key: r.value for r in index.table("meta").collect()}
    out = [f"repo: {meta.get('repo_root', '')}", f"indexed: {meta.get('indexed_at', '')}  commit {meta.get('commit_sha', '')[:12] or 'none'}"]
    out += [f"{r.language}: {r.files} files, {r.lines:,} lines" for r in parts["languages"]]
    out += ["symbols: " + ", ".join(f"{r.kind} {r.n}" for r in parts["kinds"])]
    out += ["skipped: " + ", ".join(f"{r.skipped_reason} {r.n}" for r in parts["skipped"])] if parts["skipped"] else []
    total = sum(r.n for r in parts["resolutions"])
    known = sum(r.n for r in parts["resolutions"] if r.resolution != "unresolved")
    out += [f"parse errors: {parts['totals'][0].parse_errors}", f"calls: {total}, resolved {known / total if total else 0:.0%}"]
    return out + [f"  {r.resolution} ({r.confidence:.2f}): {r.n}" for r in parts["resolutions"]]
