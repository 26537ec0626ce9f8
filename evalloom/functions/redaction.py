"""Redaction of personal data in the JVM: detect spans, settle overlaps, render.

A category's matches and the text between them come from one split and one extraction by the same pattern; running lengths
give the positions. Overlaps are settled per row by a fold over few spans, never by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories in order of priority and their patterns.
PATTERNS: dict[str, str] = {
    "cccd": r"\b(?:\d{9}|\d{12})\b",
    "phone_vn": r"(?:\+84[\s\-]?|0)(?:\d{2,3}[\s\-]?)\d{3}[\s\-]?\d{3,4}\b",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "tax_id": r"(?iu)(?:MST|TAX\s*ID|Mã\s*số\s*thuế|Ma\s*so\s*thue)[:\s\-]+\d{10}(?:[\-\s]?\d{1,3})?\b",
    "bank_account": r"(?:STK|so\s*tk|số\s*tk|tai\s*khoan|tài\s*khoản)[:\s]+\d[\d\s\-]{7,18}\d",
    "vin": r"\b[A-HJ-NPR-Z0-9]{17}\b",
    "license_plate": r"\b\d{2}[A-Z][\-\s]?\d{4,5}\b",
    "person_name": r"(?:ông|bà|anh|chị|cô|chú|bác|em|khách\s*hàng|người\s*mua|người\s*bán|đại\s*diện|người\s*đại\s*diện|buyer|seller|representative|người\s*ký|người\s*lập)\s*[:\-]?\s*([A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÈÉẺẼẸÊẾỀỂỄỆÍÌỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ][a-zàáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệíìỉĩịòóỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ]+(?:\s+[A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÈÉẺẼẸÊẾỀỂỄỆÍÌỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ][a-zàáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệíìỉĩịòóỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ]+){0,3})",
}
# Mask names of the default policy, and keys that it exempts.
MASKS = {"cccd": "CCCD", "phone_vn": "PHONE", "email": "EMAIL", "tax_id": "MST", "bank_account": "STK", "vin": "VIN", "license_plate": "PLATE", "person_name": "NAME"}
EXEMPT = ("contract_no", "model", "version", "color", "delivery_date")
ACTIONS = ("mask", "hash", "keep_token")
SPAN = "array<struct<start:int,end:int,priority:int,type:string,value:string,action:string>>"


@dataclass(frozen=True)
class Category:
    action: str = "mask"
    mask: str = "[REDACTED]"

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")


@dataclass(frozen=True)
class Policy:
    policy_version: str = "phase03.redact.v1"
    default_action: str = "mask"
    categories: dict[str, Category] = field(default_factory=dict)
    exempt_context_keys: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, data: dict) -> Policy:
        own = {n: Category(c.get("action", "mask"), c.get("mask", f"[REDACTED:{n.upper()}]")) for n, c in (data.get("categories") or {}).items()}
        return cls(data.get("policy_version", "phase03.redact.v1"), data.get("default_action", "mask"), own, tuple(data.get("exempt_context_keys", ())))

    @classmethod
    def load(cls, path: str) -> Policy:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})


DEFAULT = Policy(categories={n: Category("keep_token" if n == "person_name" else "mask", f"[REDACTED:{m}]") for n, m in MASKS.items()}, exempt_context_keys=EXEMPT)
#: A stricter policy: digits inside longer runs are no telephone numbers, prices no identity numbers.
STRICT_PATTERNS = PATTERNS | {"cccd": r"(?<![\d.,:] )\b(?:\d{12})\b", "phone_vn": r"(?<!\d)" + PATTERNS["phone_vn"]}


def _matches(text: Column, pattern: str, priority: int, name: str, action: str) -> Column:
    none = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        ahead = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda s, x: F.struct(
                (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
                F.array_append(s["spans"], F.struct((s["at"] + F.length(x["gap"])).alias("start"), (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), F.lit(priority).alias("priority"), F.lit(name).alias("type"), x["hit"].alias("value"), F.lit(action).alias("action"))).cast(SPAN).alias("spans"),
            ),
        )
        return F.when(F.size(hits) > 0, ahead["spans"]).otherwise(none)

    # the hits are bound once; only a text that has some is split, too
    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed)[0]
    return F.when(F.contains(text, F.lit("@")), found).otherwise(none) if "@" in pattern else found


def spans(text: Column, policy: Policy = DEFAULT, patterns: dict[str, str] = PATTERNS) -> Column:
    """Accepted spans by start: longest first, then earliest, then by priority; a span that overlaps an accepted one goes."""
    t = F.coalesce(text, F.lit(""))
    found = [_matches(t, rx, k, n, policy.categories[n].action) for k, (n, rx) in enumerate(patterns.items()) if n in policy.categories]
    if not found:
        return F.array().cast(SPAN)
    ranked = F.transform(F.concat(*found), lambda s: F.struct((s["start"] - s["end"]).alias("shortness"), s["start"].alias("at"), s["priority"].alias("rank"), s.alias("span")))
    best = F.aggregate(
        F.transform(F.sort_array(ranked), lambda s: s["span"]),
        F.array().cast(SPAN),
        lambda kept, s: F.when(F.exists(kept, lambda k: (s["end"] > k["start"]) & (s["start"] < k["end"])), kept).otherwise(F.array_append(kept, s).cast(SPAN)),
    )
    return F.sort_array(best)


def render(text: Column, accepted: Column, policy: Policy = DEFAULT) -> Column:
    """The text with each span masked, hashed or kept, by the policy."""
    masks = F.create_map(*[x for n, c in policy.categories.items() for x in (F.lit(n), F.lit(c.mask))]) if policy.categories else F.create_map()
    t = F.coalesce(text, F.lit(""))
    done = F.aggregate(
        accepted,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            x["end"].alias("at"),
            F.concat(
                s["out"],
                t.substr(s["at"] + 1, x["start"] - s["at"]),
                F.when(x["action"] == "mask", masks[x["type"]]).when(x["action"] == "hash", F.concat(F.lit("[HASH:"), F.substring(F.sha2(x["value"], 256), 1, 8), F.lit("]"))).otherwise(x["value"]),
            ).alias("out"),
        ),
    )
    return F.concat(done["out"], t.substr(done["at"] + 1, F.length(t)))


def counts(accepted: Column) -> Column:
    """Spans by type as a map; kept tokens are not counted."""
    types = F.transform(F.filter(accepted, lambda s: s["action"] != "keep_token"), lambda s: s["type"])
    kinds = F.array_distinct(types)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(types, lambda t: t == k)).cast("long")))


def total(accepted: Column) -> Column:
    return F.size(F.filter(accepted, lambda s: s["action"] != "keep_token")).cast("long")


def public_spans(accepted: Column) -> Column:
    """Spans as they are logged: without the value, with its hash."""
    return F.transform(accepted, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), F.substring(F.sha2(s["value"], 256), 1, 12).alias("original_hash"), s["action"].alias("action")))


def redact(text: Column, policy: Policy = DEFAULT, patterns: dict[str, str] = PATTERNS) -> Column:
    """struct(text, spans, span_count_by_type, total)."""
    t = F.coalesce(text, F.lit(""))
    # bound once: each use below would run all patterns again
    return F.transform(
        F.array(F.struct(t.alias("t"), spans(t, policy, patterns).alias("s"))),
        lambda x: F.struct(render(x["t"], x["s"], policy).alias("text"), public_spans(x["s"]).alias("spans"), counts(x["s"]).alias("span_count_by_type"), total(x["s"]).alias("total")),
    )[0]


def redact_blocks(blocks: Column, policy: Policy = DEFAULT) -> Column:
    """OCR blocks (page, text, ...): struct(blocks' texts, redacted_text joined by line feeds, spans with block_page)."""
    done = F.transform(F.coalesce(blocks, F.array().cast("array<struct<page:int,text:string>>")), lambda b: F.struct(b["page"].alias("page"), redact(b["text"], policy).alias("r")))
    return F.transform(
        F.array(done),
        lambda d: F.struct(
            F.transform(d, lambda b: F.struct(b["page"].alias("page"), b["r"]["text"].alias("text"))).alias("text_blocks"),
            F.array_join(F.transform(d, lambda b: b["r"]["text"]), "\n").alias("redacted_text"),
            F.flatten(F.transform(d, lambda b: F.transform(b["r"]["spans"], lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["original_hash"].alias("original_hash"), s["action"].alias("action"), b["page"].alias("block_page"))))).alias("pii_spans"),
        ),
    )[0]


def redact_cells(tables: Column, policy: Policy = DEFAULT) -> Column:
    """OCR tables (page, cells of row, col, text): struct(tables with redacted cells, spans with block_page, row and col)."""
    plain = F.coalesce(tables, F.array().cast("array<struct<page:int,cells:array<struct<row:int,col:int,text:string>>>>"))
    cells = lambda t: F.transform(F.coalesce(t["cells"], F.array().cast("array<struct<row:int,col:int,text:string>>")), lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), redact(c["text"], policy).alias("r")))
    done = F.transform(plain, lambda t: F.struct(t["page"].alias("page"), cells(t).alias("cells")))
    span = lambda t, c, s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["original_hash"].alias("original_hash"), s["action"].alias("action"), t["page"].alias("block_page"), c["row"].alias("row"), c["col"].alias("col"))
    return F.transform(
        F.array(done),
        lambda d: F.struct(
            F.transform(d, lambda t: F.struct(t["page"].alias("page"), F.transform(t["cells"], lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["r"]["text"].alias("text"))).alias("cells"))).alias("tables"),
            F.flatten(F.transform(d, lambda t: F.flatten(F.transform(t["cells"], lambda c: F.transform(c["r"]["spans"], lambda s: span(t, c, s)))))).alias("pii_spans"),
        ),
    )[0]
