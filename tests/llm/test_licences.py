from pagelathe.llm import licences

MIT = """The MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation.
"""
CASES = [
    ("words. Released under the MIT License.", "MIT"),
    ("a\nLicensed under CC BY-NC 4.0.\nb", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    (BSD, "BSD-2-Clause"),
    ("// SPDX-License-Identifier: MPL-2.0", "SPDX:mpl-2.0"),
    ("Copyright 2019 X. All rights reserved.", "all-rights-reserved"),
    ("Licensed under terms that nobody knows.", "UNKNOWN"),
    ("Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY 4.0.", "MIT,CC-BY-4.0"),
    ("no such words", ""), (None, ""), ("", ""),
]


def test_cases(docs):
    got = {r["doc_id"]: r for r in licences.licence_scan(docs([(k, t) for k, (t, _) in enumerate(CASES)])).collect()}
    assert {k: r["licences"] for k, r in got.items()} == {k: v for k, (_, v) in enumerate(CASES)}
    assert got[7]["n_unknown"] == got[7]["n_sentences"] == 1 and got[9]["n_sentences"] == 0


def test_full_texts(docs):
    got = {r["doc_id"]: r["sentence_ids"] for r in licences.licence_scan(docs([(1, MIT), (2, APACHE)])).collect()}
    assert "mit-grant" in got[1] and "mit-asis" in got[1] and got[2].startswith("apache-2-notice")
    found = {r["doc_id"]: r["licences"].split(",")[0] for r in licences.licence_scan(docs([(1, MIT), (2, APACHE)])).collect()}
    assert found[1].startswith("MIT") and found[2] == "Apache-2.0"


def test_odd_rows(odd_docs, docs):
    rows = licences.licence_scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["licences"] == "" for r in rows)
    assert licences.licence_scan(docs([])).collect() == []


def test_main_path_has_no_python(odd_docs):
    assert "Python" not in licences.licence_scan(odd_docs)._jdf.queryExecution().executedPlan().toString()


ANCHORLESS = [
    ("Released under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Available under CC BY 4.0.", "CC-BY-4.0"),
    ("Available under the CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("CC0 1.0", "CC0-1.0"),
    ("This work is CC0.", "CC0-1.0"),
    ("An example of simple code.", ""),
]
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, you can obtain one at
http://mozilla.org/MPL/2.0/."""


def test_known_sentences_pass_the_filter(docs):
    got = {r["doc_id"]: r for r in licences.licence_scan(docs([(k, t) for k, (t, _) in enumerate([*ANCHORLESS, (MPL, "")])])).collect()}
    assert [got[k]["licences"] for k in range(len(ANCHORLESS))] == [v for _, v in ANCHORLESS]
    assert "mpl-2-copy" in got[len(ANCHORLESS)]["sentence_ids"]


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2").replace("program.  If not, see <https://www.gnu.org/licenses/>.", "program; if not, write to the Free Software Foundation, Inc.,\n    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""


def test_published_gnu_notices(docs):
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(docs([(1, GPL3), (2, GPL2), (3, LGPL), (4, GPL3.replace("GNU General", "GNU Affero General"))])).collect()}
    assert got == {1: "GPL-3.0-or-later", 2: "GPL-2.0-or-later", 3: "LGPL-2.1-or-later", 4: "AGPL-3.0-or-later"}


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
MORE = [
    (ZLIB, "Zlib"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("All rights made available under the terms of the Eclipse Public License v2.0.", "EPL-2.0"),
    ("Licensed under CC-BY-SA-3.0.", "CC-BY-SA-3.0"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 2.5 Generic License.", "CC-BY-SA-2.5"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX:mit,SPDX:apache-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "SPDX:gpl-2.0-only with classpath-exception-2.0"),
    ("SPDX-License-Identifier: LicenseRef-" + "x" * 2000, "SPDX:licenseref-" + "x" * 2000),
    ("ALL  RIGHTS\n * reserved", "all-rights-reserved"),
]


def test_more_licences(docs):
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(docs([(k, t) for k, (t, _) in enumerate(MORE)])).collect()}
    assert got == {k: v for k, (_, v) in enumerate(MORE)}


def test_each_known_sentence_alone_is_found(docs):
    """Whatever a pattern matches passes the filter on texts: the example of each is made from the pattern itself."""
    import re

    def example(p):
        p = p.replace(".*", " zz ").replace("[0-9]{4}", "2020").replace("[0-9*-]+", "1").replace("[0-9.]+", "1").replace("[0-9]+", "1").replace("[^a-z0-9]", " ").replace("[ -]", "-")
        while (m := re.search(r"\(([^()]*)\)(\?|\+|\*)?", p)) is not None:
            p = p[: m.start()] + ("" if m[2] in ("?", "*") else m[1].split("|")[0]) + p[m.end() :]
        p = p.split("|")[0]
        return re.sub(" +", " ", re.sub(r"\\\.", ".", re.sub(r"\\?.\?", "", p))).strip()

    names = [n for n, _ in licences.SENTENCES]
    rows = [(k, example(p)) for k, (_, p) in enumerate(licences.SENTENCES)]
    got = {r["doc_id"]: r["sentence_ids"] for r in licences.licence_scan(docs(rows)).collect()}
    known = {names[k]: v for k, v in got.items()}
    assert not [(n, rows[names.index(n)][1], v) for n, v in known.items() if v in ("", licences.UNKNOWN)]
