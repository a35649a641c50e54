"""Every licence rule can fire: texts made from its own pattern hold its keyword and are found."""

import re
from re import _constants as op
from re import _parser as parser

import pytest

from clausewise.llm import licenses
from clausewise.llm.license_rules import FAMILIES, NOTICES, rules


def samples(pattern):
    """Texts that a pattern matches: all alternatives, with optional parts left out and put in."""

    def made(items, most):
        out = [""]
        for kind, arg in items:
            if kind is op.LITERAL:
                parts = [chr(arg)]
            elif kind is op.SUBPATTERN:
                parts = made(arg[3], most)
            elif kind is op.BRANCH:
                parts = [p for branch in arg[1] for p in made(branch, most)]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, inner = arg
                parts = [p * max(low, min(high, 1) if most else low) for p in made(inner, most)]
            elif kind is op.IN:
                value = arg[0][1]
                parts = ["w" if arg[0][0] is op.CATEGORY else chr(value[0] if isinstance(value, tuple) else value)]
            else:
                parts = [""]
            out = [a + b for a in out for b in parts][:200]
        return out

    tree = parser.parse(pattern)
    return {re.sub(" +", " ", s).strip() for most in (False, True) for s in made(tree, most)}


TABLE = rules()


def test_there_are_hundreds_of_signatures():
    written = {n for _, _, n, _ in FAMILIES} | {n for _, _, n in NOTICES}
    assert len(written) > 240 and len({(r.label, r.pattern) for r in TABLE}) == len(TABLE)


def test_keywords_stand_in_what_patterns_match():
    lacking = [(r.label, r.keyword, s) for r in TABLE for s in samples(r.pattern) if f" {r.keyword} " not in f" {s} "]
    assert not lacking, lacking[:20]


def plain(text, table=TABLE):
    """The scan in plain Python: all matches in order, then suppression of those inside a match of the same or a better tier."""
    words = re.findall(licenses.WORD, text.translate(str.maketrans(licenses._UPPER, licenses._LOWER)))
    norm = f" {' '.join(words)} "
    found = []
    for r in table:
        if r.keyword in norm:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                first = norm[: m.start()].count(" ") - 1
                found.append((first, -(first + m.group().count(" ")), r.tier, r.label, r.confidence))
    kept = []
    for d in sorted(found):
        if not any(k[2] <= d[2] and k[0] <= d[0] and -k[1] >= -d[1] for k in kept):
            kept.append(d)
    return len(kept), sorted({k[3] for k in kept}), max([k[4] for k in kept], default=0.0)


def test_scan_against_plain_python(spark):
    import random

    rng = random.Random(21)
    made = sorted({s for r in TABLE for s in samples(r.pattern)})
    texts = [f"lorem {s}, ipsum" for s in made]
    texts += [" and ".join(rng.sample(made, 6)) for _ in range(200)]
    texts += ["", "no licence at all", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: 0BSD"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, norm string")).collect()
    assert len(got) == len(texts)
    for r in got:
        n, labels, best = plain(texts[r.doc_id])
        assert (r.detections, list(r.labels)) == (n, labels) and r.score == pytest.approx(best), texts[r.doc_id]
    by_id = {texts[r.doc_id]: r.labels for r in got}
    assert by_id["SPDX-License-Identifier: GPL-2.0-or-later"] == ["gpl-2.0-or-later"] and by_id["SPDX-License-Identifier: 0BSD"] == ["0bsd"]
