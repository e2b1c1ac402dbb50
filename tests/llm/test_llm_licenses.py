import random
import re

import pytest
from llm_tools import ODD_TEXTS, docs

from newsloom.llm import licenses

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for phrase, label in BASE.items():
        own = phrase.split()
        for k in range(len(found) - len(own) + 1):
            if found[k:k + len(own)] == own:
                starts.append(k)
                labels.add(label)
    return (len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def test_base_places_equal_plain_search(spark):
    rng = random.Random(2)
    bits = [w for p in BASE for w in p.split()] + ["Under the MIT-License.", "Apache License, Version 2.0", "CC BY-NC", "été", "x", "cc", "by"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "  ", "\n", "-", ", "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(1, None), (None, "cc by nc"), (None, None)]
    got = licenses.scan(docs(spark, rows)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got)
    want = sorted((str(i), p[0], p[1], str(p[2]), str(p[3]), p[4]) for i, t in rows for p in [plain(t)])
    assert have == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


@pytest.mark.parametrize("text, names, allowed", [
    ("MIT", ("mit",), True),
    ("GPL-2.0-only OR MIT", ("gpl-2.0-only", "mit"), True),
    ("GPL-2.0-only AND MIT", ("gpl-2.0-only", "mit"), False),
    ("(GPL-3.0 OR Apache-2.0) AND BSD-3-Clause", ("gpl-3.0", "apache-2.0", "bsd-3-clause"), True),
    ("MIT AND GPL-2.0 OR ISC", ("mit", "gpl-2.0", "isc"), True),
    ("GPL-2.0 WITH Classpath-exception-2.0", ("gpl-2.0-with-classpath-exception-2.0",), False),
    ("MIT and then prose", ("mit", "then"), False),
    ("MIT )", ("mit",), True),
    ("(MIT", (), None), ("AND MIT", (), None), ("", (), None),
])
def test_expressions(text, names, allowed):
    if allowed is None:
        with pytest.raises(ValueError):
            licenses.evaluate(text)
    else:
        assert licenses.evaluate(text) == (names, allowed)


def test_tags_and_notices(spark):
    rows = [(1, "# SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode"), (2, "spdx-license-identifier: (("), (3, "Mozilla Public License"),
            (4, "permission is hereby granted, free of charge, to any person obtaining a copy"), (5, "all rights reserved")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[1].labels, got[1].score, got[1].permitted) == ("gpl-2.0-only,mit", 1.0, True)
    assert (got[2].labels, got[2].score, got[2].n_expressions) == ("", 0.0, 0)
    assert [got[i].labels for i in (3, 4, 5)] == ["mpl", "mit", "all-rights-reserved"]


NAMES = [f"LicenseRef-vendor-{k:03}" for k in range(2000)]


@pytest.mark.parametrize("text, labels, n, permitted", [
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0", {"mit", "apache-2.0"}, 2, True),
    ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: GPL-2.0-only", {"mit", "gpl-2.0-only"}, 2, False),
    ("SPDX-License-Identifier: " + " OR ".join(NAMES[:20] + ["MIT"]), {n.lower() for n in NAMES[:20]} | {"mit"}, 1, True),
    ("SPDX-License-Identifier: " + " AND ".join(NAMES), {n.lower() for n in NAMES}, 1, False),
    ("SPDX-License-Identifier: " + " AND (".join(NAMES) + ")" * (len(NAMES) - 1), {n.lower() for n in NAMES}, 1, False),
    ("/* SPDX-License-Identifier: (MIT OR\r\n *   GPL-2.0-only)\n * AND more */", {"mit", "gpl-2.0-only"}, 1, True),
    ("-- SPDX-License-Identifier: (MIT\n-- AND\n--\n-- ISC) AND Zlib", {"mit", "isc", "zlib"}, 1, True),
    ("# SPDX-License-Identifier: MIT OR\n# Apache-2.0", {"mit"}, 1, True),  # a line ends it outside parentheses
    ("SPDX-License-Identifier: MIT, ISC", {"mit"}, 1, True),
    ("SPDX License Identifier: MIT", {"mit"}, 1, True), ("é spdx_license.identifier (ISC)", {"isc"}, 1, True),
    ("SPDX-License-Identifier: the license of this file", {""}, 0, None),
    ("SPDX-License-Identifier: Foo-1.0 OR MIT SPDX-License-Identifier: bar", {"mit"}, 1, True),
    ("SPDX-License-Identifier: DocumentRef-x:LicenseRef-y", {"documentref-x:licenseref-y"}, 1, False),
    ("SPDX-License-Identifier: ISC; xSPDX-License-Identifier: MIT", {"isc"}, 1, True),
])
def test_whole_expressions(text, labels, n, permitted):
    got = licenses.Scanner().scan(text.encode())
    assert (set(got["labels"].split(",")), got["n_expressions"], got["permitted"]) == (labels, n, permitted)


def test_unknown_names_are_counted_apart():
    got = licenses.Scanner().scan(b"SPDX-License-Identifier: Foo-1.0 OR MIT\nSPDX-License-Identifier: bar")
    assert (got["n_expressions"], got["n_unknown"], got["labels"]) == (1, 2, "mit")
    many = licenses.Scanner().scan(b"SPDX-License-Identifier: ISC\n" * 20_000)  # linear in the number of tags
    assert many["n_expressions"] == 20_000


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
