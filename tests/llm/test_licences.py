"""Licence statements that are in no template, everyday uses of their words, and what confirms them."""

from quernstone.llm import license_scan as ls

from .test_llm import odd_docs

#: Statements and the family a reader would name; None where it is none of the families.
STATED = (
    ("This project is MIT licensed.", "mit"), ("MIT License", "mit"), ("The code is available under the terms of the MIT license.", "mit"), ("Distributed under the MIT License. See LICENSE for more information.", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: EPL-2.0", "epl"), ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl"),
    ("Publié sous licence MIT", "mit"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License);", "apache-2.0"), ("This software is released under Apache 2.0.", "apache-2.0"), ("you may not use this file except in compliance with the License. Apache License", "apache-2.0"), ("Apache License 2.0", "apache-2.0"), ("The project is licensed under the Apache Software License 2.0", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"), ("GPLv3 or any later version", "gpl"), ("Released under the GNU GPL version 3.", "gpl"), ("Licensed under the GNU General Public License v2.0", "gpl"), ("licensed under GPL-3.0", "gpl"),
    ("Licensed under the GNU Lesser General Public License, version 3", "lgpl"), ("This library is distributed under the LGPL 2.1 license", "lgpl"), ("GNU Lesser General Public License v3.0", "lgpl"),
    ("licensed under the GNU Affero General Public License v3.0", "agpl"), ("The server is released under AGPLv3.", "agpl"), ("GNU AGPL version 3", "agpl"),
    ("This code is released under a BSD-style license.", "bsd"), ("Licensed under the BSD 3-Clause License", "bsd"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"), ("Simplified BSD License", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"), ("Mozilla Public License Version 2.0", "mpl"), ("Licensed under MPL 2.0", "mpl"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"), ("Eclipse Public License - v 1.0", "epl"),
    ("ISC License", "isc"), ("Licensed under the terms of the ISC License.", "isc"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free software, licensed under the Artistic License 2.0", "artistic-2.0"), ("The Artistic License 2.0", "artistic-2.0"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0"), ("CC0 1.0 Universal: no rights reserved", "cc0"), ("Released to the public domain under CC0.", "cc0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"), ("Text is available under CC BY-SA 3.0", "cc-by-sa"),
    ("Licensed under Creative Commons Attribution-NoDerivatives 4.0", "cc-by-nd"), ("CC BY-ND 4.0", "cc-by-nd"), ("Photos: CC BY-NC 2.0", "cc-by-nc"), ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc"),
    ("Content on this site is licensed under CC BY 4.0.", "cc-by"), ("Creative Commons Attribution 4.0 International", "cc-by"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "bsl-1.0"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("This library is under the zlib license", "zlib"),
    ("Copyright 2019 Example Corp. All rights reserved.", "proprietary"), ("Proprietary and confidential.", "proprietary"), ("Alle Rechte vorbehalten.", "proprietary"), ("© 2020 Maison. Tous droits réservés.", "proprietary"),
    ("This software is licensed under the Common Development and Distribution License (CDDL)", None), ("Licensed under the EUPL, the European Union Public Licence", None), ("SIL Open Font License 1.1", None), ("licensed under the Business Source License 1.1", None), ("Microsoft Public License (Ms-PL)", None), ("Released under the Open Software License version 3.0", None), ("the Frobnicate Public License 1.0", None),
    ("The MIT license plate was found on the road", None), ("All rights reserved seats were sold out", None), ("He is licensed under state law to practise medicine", None), ("Her driving license was taken away", None), ("The fishing licence costs ten euros", None), ("An eclipse of the moon", None), ("Apache helicopters were seen over the town", None), ("the reserved table by the door", None), ("She works at MIT in the lab", None), ("Sie fuhr mit der Bahn", None), ("Copyright law is dull", None), ("a boost for the economy", None), ("they gave permission to build", None), ("poetic license", None), ("Los derechos de los niños", None),
)


def test_statements_that_are_in_no_template(spark):
    rows = {r["doc_id"]: r for r in ls.scan(odd_docs(spark, [s for s, _ in STATED])).collect()}
    got = [(s, want, rows[i]["licence"], rows[i]["confirmed"]) for i, (s, want) in enumerate(STATED)]
    named = [g for g in got if g[2]]
    wrong = [g for g in named if g[1] != g[2]]
    found = [g for g in got if g[1] and g[1] == g[2]]
    stated = [g for g in got if g[1]]
    assert len(stated) >= 60 and len(wrong) <= 0.05 * len(named), wrong
    assert len(found) >= 0.9 * len(stated), [g for g in stated if g[1] != g[2]]
    assert not [g for g in got if g[3] and g[1] != g[2]]
    assert sum(g[3] for g in found) >= 0.6 * len(found)


def test_clashing_columns_and_templates(spark):
    docs = odd_docs(spark, [x for xs in ls.TEMPLATES.values() for x in xs]).withColumnsRenamed({"kept": "paragraph", "component_id": "gram", "rank": "words"})
    want = [f for f, xs in ls.TEMPLATES.items() for _ in xs]
    got = {r["doc_id"]: r for r in ls.scan(docs).collect()}
    assert [got[i]["licence"] for i in range(len(want))] == want
    assert sum(r["confirmed"] for r in got.values()) >= 0.95 * len(want)
