"""License scans of made-up and of all given texts."""

import re
import time

from lumenframe.llm import patience_license as lic
from lumenframe.llm import queries

FILL = " ".join(f"w{i}" for i in range(60))


def scanned(spark, texts):
    rows = lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [sorted((r.start_word, r.license) for r in rows if r.doc_id == i) for i in range(len(texts))]


def test_every_template_is_found_as_itself_among_its_relatives(spark):
    names = list(lic.TEMPLATES)
    got = scanned(spark, [f"{FILL} {lic.TEMPLATES[n].upper()} {FILL}" for n in names])
    assert [g for g in got] == [[(60, n)] for n in names]


def test_relatives_are_told_apart(spark):
    gpl = lic.TEMPLATES["GPL-3.0-or-later"]
    texts = [
        gpl.replace("version 3", "version 7"), gpl.replace("General", "Sleepycat General"), "Licensed under CC BY-XX 4.0", "Licensed under CC BY-ND 4.0", "licensed under the GNU Lesser General Public License, version 3",
        lic.TEMPLATES["BSD-3-Clause"].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("copyright holder nor", "Example Foundation nor"),
        "Released under a License that the MIT wrote", "Licensed under CC BY 4.0 and not otherwise",
    ]
    got = scanned(spark, texts)
    assert got[0] == [] and [n for _, n in got[1]] == ["GPL-3.0-or-later"] and [n for _, n in got[3]] == ["CC-BY-ND-4.0-notice"]
    assert [n for _, n in got[4]] == ["LGPL-3.0-notice"] and [n for _, n in got[5]] == ["BSD-3-Clause"] and [n for _, n in got[7]] == ["CC-BY-4.0-notice"]


def test_page_headers_inside_and_many_notices(spark):
    w = lic.TEMPLATES["Apache-2.0"].split()
    header = "Page 7 of 9 The Example Company Confidential and Proprietary Draft Report Volume Two".split()
    many = "Released under the MIT License. More text here. " * 5000
    at = time.time()
    got = scanned(spark, [" ".join(w[:30] + header + w[30:]), many, None, "", lic.TEMPLATES["MIT"] + " " + lic.TEMPLATES["ISC"]])
    assert time.time() - at < 60
    assert got[0] == [(0, "Apache-2.0")] and got[2] == got[3] == []
    assert got[1] == [(8 * i, "MIT-notice") for i in range(5000)]
    assert [n for _, n in got[4]] == ["MIT", "ISC"]


def test_all_notices_of_the_documents_are_found(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {}
    for r in queries.op6_patience_license(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    pattern = {"MIT-notice": r"released under the mit license", "Apache-2.0-notice": r"licensed under the apache license,? version 2\.0", "CC-BY-4.0-notice": r"licensed under cc by 4\.0", "GPL-3.0-notice": r"this work is licensed under the gnu general public license,? version 3"}
    for i, t in docs.items():
        words = re.sub(r"\s+", " ", (t or "").lower())
        for name, p in pattern.items():
            assert len(re.findall(p, words)) <= sum(x.startswith(name.split("-notice")[0]) for x in got.get(i, [])), (i, name)
