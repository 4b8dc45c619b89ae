"""Sentences written by hand, not made from the rules: the labels that a reader would give them."""

import time

from pyspark.sql import functions as F

from lamina.llm import license_scan

SENTENCES = {
    "mit": ["This is under the MIT License.", "MIT licence applies.", "Released under the MIT license", "License: MIT License", "Licensed under MIT", "licensed under the MIT license.", "It is distributed under the terms of the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "apache": ["Apache License", "Licensed under the Apache License, Version 2.0", "released under Apache 2.0", "Apache Software License 2.0", "see http://www.apache.org/licenses/LICENSE-2.0", "the Apache License v2", "SPDX-License-Identifier: Apache-2.0",
               "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "gpl": ["licensed under the GPL", "licensed under GPL v2", "GNU GPL version 3", "GNU General Public License", "under the General Public License", "GPLv3 or later", "GPL 2.0 only", "Released under the GPL v3", "distributed under the terms of the GNU General Public License",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later", "the GPL license", "http://www.gnu.org/licenses/gpl-3.0.html"],
    "lgpl": ["LGPL 2.1", "GNU LGPL version 3", "licensed under the LGPL", "LGPLv2.1 or later", "GNU Lesser General Public License", "the GNU Library General Public License", "released under LGPL v3", "SPDX-License-Identifier: LGPL-2.1"],
    "agpl": ["AGPL 3.0", "licensed under the AGPL", "GNU Affero General Public License", "AGPLv3", "GNU AGPL version 3 or later", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl": ["MPL 2.0", "Mozilla Public License", "licensed under the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at", "licensed under the MPL", "SPDX-License-Identifier: MPL-2.0"],
    "bsd": ["BSD License", "the 3-clause BSD license", "New BSD License", "licensed under the BSD", "released under the BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["ISC license", "ISC License", "licensed under ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "zlib": ["zlib license", "zlib/libpng License", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "released under the zlib license"],
    "ruby": ["under the ruby license", "Ruby License"],
    "perl": ["under the Perl license"],
    "php": ["PHP License", "The PHP License, version 3.01"],
    "python": ["Python Software Foundation License", "licensed under the Python Software Foundation License Version 2"],
    "postgresql": ["PostgreSQL License", "released under the PostgreSQL licence"],
    "openssl": ["OpenSSL License"],
    "unlicense": ["The Unlicense", "SPDX-License-Identifier: Unlicense"],
    "wtfpl": ["You just DO WHAT THE FUCK YOU WANT TO."],
    "epl": ["Eclipse Public License", "EPL 2.0", "Eclipse Public License - v 1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "licensed under the EPL"],
    "edl": ["Eclipse Distribution License v1.0"],
    "cddl": ["CDDL 1.1", "Common Development and Distribution License", "licensed under the CDDL"],
    "cpl": ["Common Public License 1.0", "CPL 1.0"],
    "eupl": ["EUPL 1.2", "European Union Public Licence", "licensed under the EUPL"],
    "artistic": ["Artistic License 2.0", "the Artistic License", "The intent of this document is to state the conditions under which a Package may be copied"],
    "bsl": ["Boost Software License 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "any person or organization: Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "busl": ["Business Source License 1.1", "BUSL 1.1 license"],
    "ofl": ["SIL Open Font License 1.1", "This Font Software is licensed under the SIL Open Font License", "OFL 1.1"],
    "odbl": ["Open Database License", "ODbL 1.0", "licensed under the ODbL"],
    "osl": ["Open Software License 3.0", "OSL 3.0"],
    "afl": ["Academic Free License 3.0", "AFL 2.1"],
    "gfdl": ["GNU Free Documentation License", "GFDL 1.3", "licensed under the GFDL"],
    "ms-pl": ["Microsoft Public License"],
    "ms-rl": ["Microsoft Reciprocal License"],
    "ncsa": ["University of Illinois/NCSA Open Source License"],
    "upl": ["Universal Permissive License 1.0"],
    "cecill": ["CeCILL license", "CeCILL Free Software License"],
    "mulan": ["Mulan PSL license", "Mulan Permissive Software License 2"],
    "sspl": ["Server Side Public License", "SSPL v1", "licensed under the SSPL"],
    "elastic": ["Elastic License 2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution license", "licensed under CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 3.0", "licensed under CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/3.0/", "Attribution-ShareAlike license"],
    "cc-by-nc": ["CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial license"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "licensed under CC BY-NC-SA 4.0"],
    "cc0": ["CC0 license", "licensed under CC0", "https://creativecommons.org/publicdomain/zero/1.0/"],
    "public-domain": ["released into the public domain", "dedicated to the public domain"],
    "all-rights-reserved": ["All rights reserved."],
    "proprietary": ["proprietary license", "SPDX-License-Identifier: LicenseRef-Proprietary"],
    "": ["nothing here", "the public met in general", "a driving license", "he licensed the song", "common sense and open minds", "ruby and perl are languages", "version 2.0 of the text", "gnu is an animal", "by 4.0 points", "all rights and duties"],
}


def test_sentences(spark):
    cases = [(want, f"{before}{x}{after}") for want, xs in SENTENCES.items() for x in xs for before, after in (("", ""), ("So it says: ", " And more."))]
    assert len(cases) > 250
    out = license_scan.scan(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(cases)], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in out}
    words = lambda x: set(x.split(",")) - {""}
    # The base phrases' labels stay beside those of the rules: a lesser general public licence holds one.
    assert [(x, got[i]) for i, (want, x) in enumerate(cases) if words(got[i].labels) != words(want) | words(got[i].base_labels) or (got[i].score > 0) != (want != "")] == []


def test_scores_where_base_phrases_stand(spark):
    texts = [f"a {p} b {p}, {q}" for p in license_scan.BASE for q in ("", "General Public License", "released under the MIT License")]
    out = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_base >= 2 and r.score > 0 and r.detections for r in out)


def test_one_very_long_text(spark):
    """Time grows with the text, not with its square: 1 MB of one phrase, and of phrases that several rules match."""
    text = "Apache License and so on. " * 40_000
    other = "Licensed under the Apache License, Version 2.0, or the MIT License. " * 15_000
    df = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    license_scan.scan(df.limit(0)).collect()
    began = time.time()
    rows = {r.doc_id: r for r in license_scan.scan(df).select("doc_id", "n_base", "labels", F.size("detections").alias("n")).collect()}
    assert time.time() - began < 30
    assert rows[1].n_base == rows[1].n == 40_000 and rows[1].labels == "apache"
    assert rows[2].n_base == rows[2].n == 30_000 and rows[2].labels == "apache,mit"

