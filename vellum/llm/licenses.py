"""License scans by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over the canonical text: A-Z lower-cased, words joined by single
spaces, one space at either end. A rule runs only where its keyword occurs (a substring test on
the canonical text, after a test for a few words of which one must be there). Detections are word intervals; one
is suppressed where a detection of a better (smaller) priority contains its interval, or one of
equal priority that is strictly longer, or equally long and earlier in the rules.

The base phrases are counted at every place and their labels always stay.

Cases: null text counts as empty (no words, empty label strings, score 0); texts of any length
are scanned whole, in time linear in their length times the rules at work, however many matches
they hold; overlapping, tied and repeated detections are resolved as above; rows are
independent, so repeated rows give repeated results and an empty table gives none; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Between words stand ASCII characters that are neither letters nor digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# License families as (label, keyword, names, versions). Names and versions are
# regular expressions over canonical words; version texts are split at their points there.
FAMILIES = (
    ("gpl", "gnu", ("gnu general public license", "gnu general public licence", "gnu public license"), ("1", "2", "3")),
    ("gpl", "gpl", ("gnu gpl", "gpl", "gplv"), ("1", "2", "3")),
    ("lgpl", "gnu", ("gnu lesser general public license", "gnu library general public license", "gnu lesser public license"), ("2", "2 1", "3")),
    ("lgpl", "lgpl", ("gnu lgpl", "lgpl", "lgplv"), ("2", "2 1", "3")),
    ("agpl", "affero", ("gnu affero general public license", "affero general public license"), ("1", "3")),
    ("agpl", "agpl", ("gnu agpl", "agpl", "agplv"), ("1", "3")),
    ("gfdl", "free documentation", ("gnu free documentation license", "free documentation license"), ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("apache license", "apache software license", "apache public license"), ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", ("mozilla public license",), ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", ("mpl",), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", ("eclipse public license", "eclipse distribution license"), ("1 0", "2 0")),
    ("cddl", "common development", ("common development and distribution license",), ("1 0", "1 1")),
    ("cpl", "common public", ("common public license",), ("0 5", "1 0")),
    ("eupl", "european union", ("european union public licen[cs]e",), ("1 0", "1 1", "1 2")),
    ("osl", "open software", ("open software license",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", ("academic free license",), ("1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
    ("boost", "boost software", ("boost software license",), ("1 0",)),
    ("zpl", "zope", ("zope public license",), ("1 1", "2 0", "2 1")),
    ("python", "python", ("python software foundation license", "python license"), ("2", "2 0")),
    ("python", "psf", ("psf license",), ("2", "2 0")),
    ("php", "php license", ("php license",), ("3 0", "3 01")),
    ("odbl", "open database", ("open database license", "odc open database license"), ("1 0",)),
    ("odc-by", "open data", ("open data commons attribution license",), ("1 0",)),
    ("ofl", "open font", ("sil open font license", "open font license"), ("1 0", "1 1")),
    ("cc-by", "cc by", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by", ("cc by sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by", ("cc by nc",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by", ("cc by nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by", ("cc by nc sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc by", ("cc by nc nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative commons", ("creative commons attribution",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative commons", ("creative commons attribution share ?alike",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative commons", ("creative commons attribution non ?commercial",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative commons", ("creative commons attribution no ?deriv(?:ative|ativ|s|atives)?",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative commons", ("creative commons attribution non ?commercial share ?alike",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", "cc0", ("cc0",), ("1 0",)),
)
# Single signatures as (label, keyword, regular expression, priority).
NOTICES = (
    ("mit", "mit licen", "mit license", 3),
    ("mit", "mit licen", "(?:the )?mit licen[cs]e mit", 2),
    ("mit", "expat", "expat mit license|mit expat license", 2),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies", 1),
    ("isc", "isc licen", "isc licen[cs]e", 3),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software", 1),
    ("bsd", "bsd", "bsd (?:style )?licen[cs]e", 3),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", 2),
    ("bsd-2-clause", "freebsd", "freebsd(?: licen[cs]e)?", 2),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", 2),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", 2),
    ("0bsd", "0bsd", "0bsd", 2),
    ("0bsd", "zero clause", "zero clause bsd", 2),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 1),
    ("zlib", "zlib", "zlib (?:libpng )?licen[cs]e", 3),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty", 2),
    ("unlicense", "unlicense", "(?:the )?unlicense", 3),
    ("unlicense", "public domain", "free and unencumbered software released into the public domain", 1),
    ("wtfpl", "wtfpl", "wtfpl", 3),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 2),
    ("public-domain", "public domain", "public domain dedication", 2),
    ("proprietary", "all rights reserved", "all rights reserved", 5),
    ("proprietary", "proprietary", "proprietary and confidential", 4),
    ("copyright", "copyright", "copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?", 6),
    ("spdx", "spdx", "spdx license identifier(?: [a-z0-9]+){1,4}", 4),
    ("apache", "apache", "apache licen[cs]e", 3),
    ("apache", "apache", "apache 2(?: 0)?", 4),
    ("gpl", "gnu", "gnu general public licen[cs]e as published by the free software foundation", 1),
    ("lgpl", "gnu", "gnu lesser general public licen[cs]e as published by the free software foundation", 1),
    ("cc-by", "cc by", "cc by", 5),
    ("cc", "creative commons", "creative commons(?: licen[cs]e)?", 6),
    ("ms-pl", "microsoft", "microsoft public license", 3),
    ("ms-rl", "microsoft", "microsoft reciprocal license", 3),
    ("openssl", "openssl", "openssl license", 3),
    ("ruby", "ruby license", "ruby license", 3),
    ("vim", "vim license", "vim license", 3),
    ("x11", "x11", "x11 license|mit x11", 3),
    ("postgresql", "postgresql", "postgresql licen[cs]e", 3),
    ("json", "good not evil", "the software shall be used for good not evil", 1),
    ("llama", "community license", "llama(?: [0-9]){0,3} community license", 3),
    ("openrail", "openrail", "(?:bigscience |creativeml )?openrail(?: m)?(?: license)?", 3),
    ("openrail", "open rail", "(?:bigscience |creativeml )?open rail(?: m)?(?: license)?", 3),
)


def rules() -> list[tuple[int, str, str, str, int]]:
    """(order, label, keyword, regex, priority): each family by version and wording, then the notices."""
    out = []
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            for version in versions:
                tail = name.endswith("v") and "" or " (?:license )?(?:version |v ?)?"
                only = f"{name}{tail}{version}"
                out.append((f"{label}-{version.replace(' ', '.')}", keyword, only, 3))
                if label in ("gpl", "lgpl", "agpl", "gfdl"):
                    out.append((f"{label}-{version.replace(' ', '.')}-or-later", keyword, f"{only} (?:0 )?(?:or (?:any |at your option any )?later(?: version)?|plus)", 2))
            out.append((label, keyword, f"(?:licensed|distributed|released|available) under (?:the )?(?:terms of )?(?:the )?{name}", 2 if label not in ("cc-by",) else 4))
    out += list(NOTICES)
    # A keyword is looked for at the start of a word.
    return [(i, label, f" {keyword}", rf"(?<= )(?:{regex})(?= )", priority) for i, (label, keyword, regex, priority) in enumerate(out)]


def coarse_gate() -> list[str]:
    """A few words of which each text that holds any keyword and could match a rule holds one.

    A rule that always asks for a licence needs `licen`; others keep their keyword, unless it
    holds another one of these.
    """
    out = set()
    for _, _, keyword, regex, _ in rules():
        whole = re.fullmatch(r"\(\?<= \)\(\?:(.*)\)\(\?= \)", regex)[1]
        needed = re.sub(r"\(\?:[^()]*\)\??", "", whole)  # what no group holds
        out.add("licen" if all("licen" in part for part in needed.split("|")) else keyword)
    return sorted(k for k in out if not any(other != k and other in k for other in out))


def longest(regex: str) -> int:
    """A bound of the words that a rule's match can have."""
    body = re.fullmatch(r"\(\?<= \)\(\?:(.*)\)\(\?= \)", regex)[1]
    spread = re.sub(r"\(\?:([^()]*)\)\{\d+,(\d+)\}", lambda m: m[1] * int(m[2]), body)
    if re.search(r"[ ).][*+]|[ ).]\{\d+,", spread):
        raise ValueError(f"no bound of a match's words: {regex}")
    return spread.count(" ") + 1


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def lowered(text: Column) -> Column:
    """A-Z lower-cased as far as ASCII words go.

    The two other characters whose lower case holds an ASCII letter are replaced first, so that
    no ASCII letter appears where there was none; other letters' case changes no word's place.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("\u00df")), F.lit("\u212a"), F.lit("\u00df")))


def canonical(text: Column) -> Column:
    """The words of a text, lowered, each between single spaces; one space if there are none."""
    body = F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(body == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


#: Marks around a match; canonical texts hold no control characters.
OPEN, CLOSE = "\x01", "\x02"
PLACES = "array<struct<start:int,stop:int>>"


def starts(canon: Column, regex: Column) -> Column:
    """array<struct<start, stop>>: word intervals (stop exclusive) of a regex's matches, in order.

    Matches are marked and the marked text is split at its spaces, so that the time is linear
    in the text's length, however many matches it has. A match begins and ends with a word.
    """

    def places(marked: Column) -> Column:
        words = F.split(marked, " ")
        first = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(OPEN)), i - 1)), lambda x: x.isNotNull())
        last = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(CLOSE)), i)), lambda x: x.isNotNull())
        return F.when(F.contains(marked, F.lit(OPEN)), F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))))

    # An array of one, so that the marked text is made once.
    marked = F.array(F.regexp_replace(canon, regex, F.lit(f"{OPEN}$0{CLOSE}")))
    return F.coalesce(F.get(F.transform(marked, places), F.lit(0)), F.array().cast(PLACES))


def suppressed(found: Column, reach: Column) -> Column:
    """The detections that no other beats, in order of place.

    Sorted by start, the longer first, then by priority and order, whatever beats a detection
    stands before it: it contains it and its priority is no worse. As no rule's matches
    overlap, at most `reach` detections (the rules at work times the longest match) begin less
    than a match's length before it, so that only these are looked at.
    """
    place = lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["priority"].alias("priority"), d["order"].alias("order"), d["label"].alias("label"))
    # An array of one: lambda variables are evaluated once, other expressions for each element.
    bound = F.array(F.struct(F.sort_array(F.transform(found, place)).alias("rows"), reach.alias("reach")))

    def standing(both: Column) -> Column:
        rows, reach = both["rows"], both["reach"]
        # By places: a slice would copy the whole array for each detection.
        ahead = lambda i: F.when(i > 0, F.sequence(F.greatest(F.lit(0), i - reach), i - 1)).otherwise(F.array().cast("array<int>"))
        beats = lambda e, d: (e["back"] <= d["back"]) & (e["priority"] <= d["priority"])
        return F.filter(rows, lambda d, i: ~F.exists(ahead(i), lambda j: beats(F.get(rows, j), d)))

    return F.transform(F.get(F.transform(bound, standing), F.lit(0)), lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["order"].alias("order"), d["start"].alias("start"), (-d["back"]).alias("stop")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, base (intervals by phrase), kept (detections left after suppression)."""
    table = rules()
    # One literal, folded by the optimizer: hundreds of struct expressions take seconds to build.
    names = ("order", "label", "keyword", "regex", "priority")
    rows = F.from_json(F.lit(json.dumps([dict(zip(names, rule, strict=True)) for rule in table])), "array<struct<order:int,label:string,keyword:string,regex:string,priority:int>>")
    words = coarse_gate()
    out = docs.select(*keep, canonical(F.col(text)).alias("_canon"))
    n_words = F.when(F.col("_canon") == " ", F.lit(0)).otherwise(_spaces(F.col("_canon")) - 1)
    none = F.array().cast("array<struct<label:string,start:int,stop:int>>")

    def places(phrase: str, label: str) -> Column:
        found = F.transform(starts(F.col("_canon"), F.lit(rf"(?<= ){phrase}(?= )")), lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start"), m["stop"].alias("stop")))
        return F.when(F.contains("_canon", F.lit(f" {phrase} ")), found).otherwise(none)

    base = [places(phrase, label) for phrase, label in BASE]
    gate = reduce(lambda a, b: a | b, [F.contains("_canon", F.lit(k)) for k in words])
    active = F.filter(rows, lambda r: F.contains(F.col("_canon"), r["keyword"]))
    found = F.flatten(
        F.transform(
            active,
            lambda r: F.transform(
                starts(F.col("_canon"), r["regex"]),
                lambda m: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["order"].alias("order"), m["start"].alias("start"), m["stop"].alias("stop")),
            ),
        )
    )
    found_type = "array<struct<label:string,priority:int,order:int,start:int,stop:int>>"
    out = out.withColumns({"n_words": n_words.cast("long"), "base": F.concat(*base), "found": F.when(gate, found).otherwise(F.array().cast(found_type))})
    at_work = F.size(F.array_distinct(F.transform("found", lambda d: d["order"])))
    kept = F.when(F.size("found") > 1, suppressed(F.col("found"), at_work * max(longest(r) for _, _, _, r, _ in table))).otherwise(F.col("found"))
    return out.withColumn("kept", kept).drop("_canon")


def digest(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, places, label strings and a score of certainty: the best priority's, 1 down to 1/6."""
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    base_labels = F.transform("base", lambda x: x["label"])
    all_labels = F.concat(base_labels, F.transform("kept", lambda x: x["label"]))
    best = F.array_min(F.concat(F.transform("kept", lambda x: x["priority"]), F.transform("base", lambda x: F.lit(3))))
    return scanned.select(
        *keep,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(all_labels)), ",").alias("labels"),
        F.coalesce((7 - best) / F.lit(6.0), F.lit(0.0)).alias("score"),
    )
