"""Gates: predicates and first-reason columns that keep rows out, and the fields they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# License names by pattern, in the order in which they are tried.
FIELD_TYPES = [("MIT", "(?i)MIT"), ("Apache-2.0", "(?i)Apache"), ("AGPL-3.0", "(?i)AGPL"), ("LGPL-3.0", "(?i)LGPL"), ("GPL", r"GPL[ -]*(?:\(>=?\s*)?(\d)"), ("BSD", "(?i)BSD"), ("CC0-1.0", "(?i)CC0"), ("MPL-2.0", "(?i)MPL")]
GNU_HEAD = r"(?is)GNU (Lesser ?)?General Public License.*?Version (\d)"
#: Disk use in kB from which a repository is too large.
TOO_LARGE = 2_000_000


def _first(cases: list[tuple[Column, Column | str]], otherwise=None) -> Column:
    """The value of the first case that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda rest, case: F.when(case[0], lit(case[1])).otherwise(rest), reversed(cases), F.lit(otherwise).cast("string") if not isinstance(otherwise, Column) else otherwise)


def description_license(description: Column) -> Column:
    """The license field of a DESCRIPTION without its pointer to a file; null if there is none or it is only a pointer."""
    field = F.regexp_extract(description, r"(?im)^License:\s*(.+)$", 1)
    bare = T.strip(F.regexp_replace(field, r"(?i)\+\s*file\s*LICEN[SC]E.*$", ""))
    return F.when(~F.lower(field).startswith("file ") & (bare != ""), bare)


def repository_license(description: Column, license_file: Column) -> Column:
    """A repository's license type: by its DESCRIPTION's field, else by the first 600 characters of its license file, else unknown."""
    field = T.strip(F.regexp_extract(F.coalesce(description, F.lit("")), r"(?im)^License:\s*(.+)$", 1))
    number = F.regexp_extract(field, dict(FIELD_TYPES)["GPL"], 1)
    named = [(F.coalesce(field.rlike(p), F.lit(False)), F.concat(F.lit("GPL-"), number) if n == "GPL" else n) for n, p in FIELD_TYPES]
    rest = F.substring(T.strip(F.split_part(F.split_part(field, F.lit("|"), F.lit(1)), F.lit("+"), F.lit(1))), 1, 40)
    head = F.substring(F.coalesce(license_file, F.lit("")), 1, 600)
    gnu = F.regexp_extract(head, GNU_HEAD, 2)
    by_file = _first(
        [
            (F.contains(head, F.lit("Apache License")), "Apache-2.0"),
            (head.rlike("MIT License|Permission is hereby granted, free of charge"), "MIT"),
            (gnu != "", F.concat(F.when(F.regexp_extract(head, GNU_HEAD, 1) != "", "LGPL-").otherwise("GPL-"), gnu)),
            (F.contains(head, F.lit("Mozilla Public License")), "MPL-2.0"),
        ],
        F.lit("unknown"),
    )
    return F.when(field != "", _first(named, F.when(rest != "", rest).otherwise("unknown"))).otherwise(by_file)


def active(pushed_at: Column, since: str, missing: Column, archived: Column, fork: Column, disk_kb: Column) -> Column:
    """Repositories that exist, are neither archived nor forks nor too large, and were pushed to since a date."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return no(missing) & no(archived) & no(fork) & F.coalesce(pushed_at >= since, F.lit(False)) & (F.coalesce(disk_kb, F.lit(0)) < TOO_LARGE)


def in_areas(area: Column, areas: list[str]) -> Column:
    return F.coalesce(area.isin(*areas), F.lit(False))


def json_object(text: Column) -> Column:
    """The JSON object in an answer, as text: without fences, from the first brace to the last; null if that is no object."""
    bare = T.strip(F.regexp_replace(F.regexp_replace(T.strip(text), "^```(json)?", ""), "```$", ""))
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def spec_reason(obj: Column, field: str, least: int = 0, most: int = 0) -> Column:
    """Why an object (JSON text) fails a spec: its target field is missing, no string, or out of bounds; null if it passes."""
    v = F.try_parse_json(obj)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    size = F.length(T.strip(F.try_variant_get(v, f"$.{field}", "string")))
    cases = [(obj.isNull(), "no object"), (kind.isNull(), f"response lacks '{field}'"), (kind != "STRING", f"'{field}' is no string")]
    if least:
        cases.append((size < least, f"'{field}' shorter than {least} chars"))
    if most:
        cases.append((size > most, f"'{field}' longer than {most} chars"))
    return _first(cases)


def row_reason(prefix: Column, old: Column, new: Column, cursor: Column, event: Column) -> Column:
    """Why an assembled row has the wrong shape; null if it passes."""
    bad = lambda c: c.isNull() | (F.size(c) == 0)
    multi = lambda c: F.exists(c, lambda x: x.isNull() | F.contains(x, F.lit("\n")))
    fields = {"prefix": prefix, "region_old": old, "region_new": new}
    cases = [(bad(c), f"{n} must be a non-empty list") for n, c in fields.items()] + [(multi(c), f"{n} must be single-line strings") for n, c in fields.items()]
    cases += [
        (~old.eqNullSafe(F.array(F.lit(""))), "region_old must be the empty cursor line"),
        (~cursor.eqNullSafe(F.lit(0)), "cursor_idx must be 0"),
        (~F.exists(new, lambda x: T.strip(x) != ""), "region_new must be non-blank"),
        (~event.eqNullSafe(F.lit("")), "case rows carry no event"),
    ]
    return _first(cases)


def document_skip(text: Column, tokens: Column, least_bytes: int, least_tokens: int) -> Column:
    """Why a document is skipped: binary (a NUL), short or few_tokens; null if it is used."""
    return _first([(F.contains(text, F.lit("\0")), "binary"), (F.coalesce(F.octet_length(text), F.lit(0)) < least_bytes, "short"), (F.coalesce(tokens, F.lit(0)) < least_tokens, "few_tokens")])


def region_skip(old: Column, new: Column, most: int, growth: int = 2) -> Column:
    """Why a region is skipped: empty, unchanged or too_big; null if it is used."""
    n = F.size(new)
    return _first([(old.isNull() | (F.size(old) == 0) | (n == 0), "empty"), (old == new, "unchanged"), ((F.size(old) > most) | (n > most + growth), "too_big")])


def hunk_usable(added: Column, removed: Column, most: int) -> Column:
    """Hunks that add a line and change no more than `most`."""
    return (added >= 1) & (added + removed <= most)


def rewrite_gates(parses: Column, lint_old: Column, lint_new: Column, diff_lines: Column, loc_delta: Column, behaviour: Column, bench: Column, hot_static: Column) -> dict[str, Column]:
    """Gates of a rewrite from its measurements: tri-state columns by name, hot, value, and the verdict.

    behaviour: (size, equal, env_bearing); bench: (size, orig_ms, orig_iqr_ms, speedup). A rewrite is hot
    if the old code's time at least doubles from the smallest to the largest measured size, or,
    without two sizes, if it looks hot. Hot ones may grow by 4 lines and must be twice as fast at the
    largest size, with quartiles within 30 % of the time. Unknown core gates reject.
    """
    used = F.array_sort(F.transform(F.filter(F.coalesce(bench, F.array().cast("array<struct<size:bigint,orig_ms:double,orig_iqr_ms:double,speedup:double>>")), lambda b: F.coalesce(b["speedup"], F.lit(0.0)) != 0), lambda b: F.struct(b["size"].alias("size"), b["orig_ms"].alias("ms"), b["orig_iqr_ms"].alias("iqr"), b["speedup"].alias("speedup"))))
    first, last = F.get(used, F.lit(0)), F.get(used, F.size(used) - 1)
    hot = F.when(F.size(used) >= 2, last["ms"] / F.greatest(first["ms"], F.lit(1e-9)) >= 2).otherwise(F.coalesce(hot_static, F.lit(False)))
    equal = F.filter(F.coalesce(behaviour, F.array().cast("array<struct<size:bigint,equal:boolean,env_bearing:boolean>>")), lambda b: F.coalesce(b["equal"], F.lit(False)))
    env = F.coalesce(F.exists(behaviour, lambda b: F.coalesce(b["env_bearing"], F.lit(False))), F.lit(False))
    gates = {
        "G0_parse": F.coalesce(parses, F.lit(False)),
        "G1_lint": lint_new <= lint_old,
        "G2_diff": (diff_lines <= 30) & (loc_delta <= F.when(hot, 4).otherwise(0)),
        "G3_behavior": (F.size(equal) >= 3) & ~env,
        "G4_perf": F.when(hot & (F.size(used) > 0), (last["speedup"] >= 2) & (F.coalesce(last["iqr"], F.lit(1.0)) < 0.3 * F.greatest(F.coalesce(last["ms"], F.lit(1.0)), F.lit(1e-9)))),
        "G5_value": (loc_delta < 0) | F.coalesce(lint_new < lint_old, F.lit(False)) | F.coalesce(F.array_max(F.transform(used, lambda b: b["speedup"])) >= 2, F.lit(False)),
    }
    core = reduce(lambda a, b: a & b, [F.coalesce(gates[g], F.lit(False)) for g in ("G1_lint", "G2_diff", "G3_behavior")])
    verdict = _first([(~gates["G0_parse"], "reject_G0"), (~core, "reject"), (hot & ~F.coalesce(gates["G4_perf"], F.lit(True)), "reject_no_perf_gain"), (~F.coalesce(gates["G5_value"], F.lit(False)), "reject_no_value_no_op_wins")], F.lit("accept"))
    return gates | {"hot": hot, "verdict": verdict}


def documented_delta(old_params: Column, new_params: Column, old_doc: Column, new_doc: Column, most: int = 3) -> Column:
    """Whether the documented parameters change exactly as the signature's do, and by no more than `most`; null lists never do."""
    added, removed = F.array_except(new_params, old_params), F.array_except(old_params, new_params)
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    n = F.size(added) + F.size(removed)
    return F.coalesce((F.size(old_params) > 0) & (F.size(new_params) > 0) & (n >= 1) & (n <= most) & same(F.array_except(new_doc, old_doc), added) & same(F.array_except(old_doc, new_doc), removed), F.lit(False))
