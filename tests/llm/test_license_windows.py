import textwrap

import numpy as np
import pyarrow as pa

from aktarium.llm import licenses

NOTICE = "Permission is hereby granted, free of charge,\n# to any person obtaining a copy of this\n# software and associated documentation\n# files"


def test_wrapped_notices_in_long_blocks():
    words = "\n".join("# these words say nothing of the matter at hand" for _ in range(60))
    text = f"{words}\n# {NOTICE}\n{words}\n# All rights\n# reserved.\n{words}"
    found = [(f.family, text[f.start : f.end]) for f in licenses.scan(licenses.train(), text) if f.confirmed]
    assert found == [("mit", NOTICE), ("proprietary", "All rights\n# reserved")]


def test_notices_of_two_sentences_in_one_line():
    notice = "Licensed under the MIT license. See the LICENSE file for details."
    for text in (notice, "Some words come first here. " * 80 + notice + " More words follow." * 80):
        assert [(f.family, f.confirmed) for f in licenses.scan(licenses.train(), text)] == [("mit", True)]


# Ways to name a licence that training hasn't, and sentences with the same words that name none.
HELD_OUT = ("Published under {}", "This file is covered by the {}.", "We share this under {}", "The following text comes with the {}", "Copying is allowed as the {} says", "It is offered to you under {} terms", "Rights are granted as in {}")
NO_LICENCE = (
    "Published under a false name by the general", "This file is covered by dust", "We share all of the work with the public", "Er kommt mit dem Zug und mit dem Rad", "A creative mind has much in common with others", "The Apache and the Mozilla teams met at MIT",
    "the the the and and and of of to to", "Version 2 of the page is under construction, see the file", "He has a driving licence", "Permission was asked and notice was given", "by 4 or by 3 in 2024", "GNU is a recursive name",
)


def test_recall_and_precision_on_sentences_that_training_has_not():
    model, right = licenses.train(), []
    for frame in HELD_OUT:
        for family, names in licenses.NAMES.items():
            for name in names:
                found = licenses.scan(model, "Some words come before. " + frame.format(name) + " Others follow here.")
                right.append({f.family for f in found} == {family})
    assert sum(right) >= 0.95 * len(right)
    assert [t for t in NO_LICENCE if licenses.scan(model, t)] == []


def test_wrapped_at_any_width_behind_any_number_of_words():
    model, notice = licenses.train(), licenses.TEMPLATES["mit"][2]
    for n in (0, 100, 400, 5000):
        for width in (30, 50, 80, 120):
            text = textwrap.fill("these words say nothing of the matter " * (n // 7) + notice, width)
            found = licenses.scan(model, text)
            assert [(f.family, f.confirmed) for f in found] == [("mit", True)], (n, width)
            assert text[found[0].start : found[0].end].split() == notice.split()


def plain_windows(model, words):
    """Every window weighed by itself: whether one names a family."""
    for n in licenses.WINDOWS:
        for k in range(len(words) - n + 1):
            part = words[k : k + n]
            margins = model.constants.copy()
            for a in part:
                margins = margins + model.weights[model.words.get(a, 0)] / np.sqrt(2 * n - 1)
            for a, b in zip(part, part[1:], strict=False):
                margins = margins + model.weights[model.pairs[model.words.get(a, 0), model.words.get(b, 0)]] / np.sqrt(2 * n - 1)
            e = np.exp((margins - margins.max()) / model.temperature)
            if e[1:].max() / e.sum() >= model.least + 1e-9:
                yield k, n


def test_windows_equal_brute_force_and_no_text_is_passed_over(spark, tiny):
    model = licenses.train()
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text and len(r.text) < 4000] + [None, "", "LGPL", "under the\nGNU LGPL", "Rel\u00e9ased under the MIT L\u0130CENSE, Released under MIT licence"]
    may = licenses.may_name(model, pa.array(texts))
    for t, m in zip(texts, may.tolist(), strict=True):
        windows = set(plain_windows(model, licenses.words_of(t or "")))
        assert m or not windows
        found = licenses._named(model, model.numbers(licenses.words_of(t or "")))
        assert windows <= {f[:2] for f in found}
        assert bool(found) <= m


# Licences that training has neither templates nor names of, and sentences that training hasn't.
FOREIGN = (
    "Eclipse Public License 2.0", "Boost Software License 1.0", "European Union Public Licence 1.2", "Microsoft Public License", "SIL Open Font License 1.1", "Python Software Foundation License", "CDDL 1.0",
    "Common Development and Distribution License", "Artistic License 2.0", "zlib License", "Academic Free License 3.0", "Open Software License 3.0", "PostgreSQL License", "PHP License 3.01", "Ruby License",
    "Sleepycat License", "Open Database License", "IBM Public License 1.0", "NASA Open Source Agreement", "Qt Public License", "EPL-2.0", "EUPL-1.2", "OFL-1.1", "Business Source License 1.1",
)
SENTENCES = (
    "Licensed under the {}.", "Released under {}", "This project uses the {} for all code.", "Distributed under the terms of the {}, see the file.", "You may choose the {} instead.",
    "License: {}", "SPDX-License-Identifier: {}", "The library is covered by the {}", "All content here is under {}.", "Use is governed by the {} in the LICENSE file",
)
EVERYDAY = [f"The {a} {b} {c}." for a in ("driving license", "ratio of 1.0 to 2.0", "version 3.0 of the driver", "public software", "general", "right of way", "copy of the book", "work of the author") for b in ("was shown", "is free", "was released under pressure", "came with conditions", "is reserved") for c in ("in public", "by all means", "for any purpose", "without warranty", "in version 2")]


def test_licences_that_are_not_known_are_named_nothing():
    model = licenses.train()
    named = [(f, s) for f in FOREIGN for s in SENTENCES if licenses.scan(model, s.format(f))]
    assert len(named) <= 0.02 * len(FOREIGN) * len(SENTENCES), named
    odd = ["The ratio was 1.0 in total.", "version 2.0 of the driver", "The general public license to fish", "confidential", "from 3.0 to 4.0 in version 2.0"]
    assert len(EVERYDAY) == 200 and [t for t in EVERYDAY + odd if licenses.scan(model, t)] == []


def test_both_of_two_licences_are_found():
    model, families = licenses.train(), list(licenses.TEMPLATES)
    pairs = [(a, b) for k, a in enumerate(families) for b in families[k + 1 :]]
    assert len(pairs) == 91
    for form in ("Dual licensed under the {} or the {} at your option.", "This is available under {} and {}."):
        for a, b in pairs:
            text = form.format(licenses.NAMES[a][0], licenses.NAMES[b][0])
            found = licenses.scan(model, text)
            assert {f.family for f in found} == {a, b}, text
            assert all(x.end <= y.start for x, y in zip(found, found[1:], strict=False))
    three = licenses.scan(model, "The MIT License, the BSD license and the GPL are accepted.")
    assert [f.family for f in three] == ["mit", "bsd", "gpl"]
    row = licenses.scan(model, "Released under the MIT License. Licensed under the Apache License, Version 2.0. " * 500)
    assert [f.family for f in row] == ["mit", "apache-2.0"] * 500 and all(f.confirmed for f in row)


def test_short_templates_confirm_only_as_a_line_or_sentence():
    model = licenses.train()
    sure = lambda t: [f.family for f in licenses.scan(model, t) if f.confirmed]
    for t in ("All rights reserved.", "(c) 2020 Foo, all rights reserved", "Some words. All rights reserved.\nMore", "# All rights\n# reserved\n"):
        assert sure(t) == ["proprietary"], t
    for t in ("All rights reserved by the museum", "all rights reserved seats are free", "he said all rights reserved were his"):
        assert sure(t) == [], t


def test_slices_do_not_matter(monkeypatch):
    model, rng = licenses.train(), np.random.default_rng(8)
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.UNRELATED) + [f"{n} or {m}" for n in ("GPL-2.0", "MIT License") for m in ("LGPL", "BSD license")]
    text = "\n".join(str(x) for x in rng.choice(lines, 300))
    whole = licenses.scan(model, text)
    for size in (200, 1000, 7777):
        monkeypatch.setattr(licenses, "_SLICE", size)
        assert licenses.scan(model, text) == whole


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    model = licenses.train()
    text = ("nothing is said here of any terms, or of what others may do with it. " * 300 + licenses.TEMPLATES["mit"][2] + ".\n") * 500
    tracemalloc.start()
    found = licenses.scan(model, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 10_000_000 and [f.family for f in found] == ["mit"] * 500 and peak < 60_000_000
