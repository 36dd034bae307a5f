"""Published formats of written documents, as schemas of the operators in ``operators/schemas.py``."""

from __future__ import annotations


def text(longest: int | None = None, shortest: int | None = None, like: str | None = None) -> dict:
    return {"type": ["string"], "maxLength": longest, "minLength": shortest, "pattern": like}


def choice(*values: str) -> dict:
    return {"enum": list(values)}


def kind(*names: str) -> dict:
    return {"type": list(names)}


def many(items: dict | str, most: int | None = None, least: int | None = None) -> dict:
    return {"type": ["array"], "items": items, "maxItems": most, "minItems": least}


def record(required: str = "", /, **fields: dict | str) -> dict:
    """An object with these fields and no others; a field may name one of the shared parts."""
    return {"type": ["object"], "required": required.split(), "properties": fields, "closed": True}


def keyed(names: str, values: dict) -> dict:
    """An object with any fields whose names look like ``names``."""
    return {"type": ["object"], "names": names, "others": values}


# The limits of the two formats.
PHASES = ["setup", "imports", "constants", "definitions", "input", "transform", "branch", "output", "finish", "error"]
PARTS = {
    "scene": record(
        "id phase title",
        id=text(like="^[a-z0-9][a-z0-9_-]*$"),
        phase=choice(*PHASES),
        title=text(60),
        narration=text(320),
        status=choice("ran", "skipped", "possible", "sandboxed", "failed"),
        layout=choice("flow", "grid", "branch"),
        actor="card",
        inputs=many("card", 4),
        outputs=many("card", 4),
        items=many("item", 24),
        branch=record(
            "condition paths",
            condition=text(140),
            question=text(100),
            paths=many(record("label status", label=text(60), status=choice("taken", "not_taken", "possible"), goto=text()), 4, 2),
        ),
        stats=many("stat", 4),
        children=many("scene", 12),
    ),
    "card": record(
        "kind label",
        kind=choice("function", "data", "file", "database", "api", "constant", "config", "library", "module", "message", "email", "process"),
        label=text(60),
        sublabel=text(80),
        status=choice("ran", "skipped", "possible", "sandboxed", "blocked", "failed"),
        detail=text(600),
        code=record(file=text(), line=kind("integer"), snippet=text(1600), highlight=many(kind("integer"))),
        data=record(
            rows=kind("integer"),
            cols=kind("integer"),
            shape=text(40),
            columns=many(text(), 40),
            sample=record(columns=many(text()), rows=many(many(text()), 5)),
            note=text(160),
        ),
    ),
    "item": record(
        "label",
        label=text(50),
        value=text(80),
        kind=choice("stdlib", "third_party", "project", "constant", "config", "secret", "function", "class", "module"),
        note=text(120),
        status=choice("ran", "skipped", "possible"),
    ),
    "stat": record("label value", label=text(40), value=kind("number", "string"), unit=text(12), delta=kind("number")),
}
STORYBOARD = record(
    "schema title mode scenes",
    schema=text(like=r"^[^.]+\.storyboard/1$"),
    title=text(80),
    subtitle=text(160),
    mode=choice("scan", "run"),
    entry=text(),
    run=record(
        status=choice("ok", "exit", "error"),
        started_at=text(),
        duration_ms=kind("number"),
        args=many(text()),
        safe_mode=kind("boolean"),
        error=text(),
    ),
    scenes=many("scene", 60, 1),
    summary=record(headline=text(120), stats=many("stat", 6), notes=many(text(200), 5)),
)
WALKTHROUGH = record(
    "schema title explanations",
    schema=text(like=r"^[^.]+\.walkthrough/1$"),
    title=text(80, 1),
    subtitle=text(200),
    entry=text(200),
    explanations=keyed("^.+:[0-9]+(#[0-9]+)?$", record("title text", title=text(60, 1), text=text(700, 1))),
    notes=keyed("^s[0-9]+$", text(300, 1)),
)
FORMATS = {"storyboard/1": STORYBOARD, "walkthrough/1": WALKTHROUGH}
