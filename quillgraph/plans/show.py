"""Results as plain text."""

from __future__ import annotations

from quillgraph.plans.engine import Result


def shown(result: Result) -> str:
    """Answers, message, evidence, paths and trace, a line each."""
    lines = [result.message] if result.message else []
    lines += [f"- {a}" for a in result.answers]
    for e in result.evidence:
        lines.append(f"  [{e.get('document_id')}, sentence {e.get('sentence_id')}] {e.get('sentence') or ''} ({confidence(e.get('confidence'))})")
        lines += resolutions(e)
    lines += [path(p) for p in result.paths]
    return "\n".join([*lines, *result.trace])


def confidence(value: float | None) -> str:
    if value is None:
        return "no confidence given"
    return f"{value:.2f}, " + ("stated" if value >= 0.995 else "through a reference" if value >= 0.895 else "inferred")


def resolutions(edge: dict) -> list[str]:
    """Where the text used a reference instead of the name."""
    if not edge.get("coref_resolved"):
        return []
    pairs = ((edge.get("original_subject"), edge.get("src_label")), (edge.get("original_object"), edge.get("dst_label")))
    return [f'  "{said}" stands for {name}' for said, name in pairs if said and name and said != name]


def path(hops: list[dict]) -> str:
    return "; ".join(f"{h['from']} --{h['relation']}--> {h['to']} [{h['document_id']}]" for h in hops)
