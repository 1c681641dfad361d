"""Wordings by which texts state a license: bodies or their openings, the headers of source files, and short forms."""

from __future__ import annotations

#: Bodies that are short, the openings of long ones, and the headers that licenses ask for in source files.
BODIES: dict[str, str] = {
    "mit-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
    "do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-body": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, "
    "AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by "
    "Sections 1 through 9 of this document.",
    "gnu-body": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-3.0-body": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2.0-body": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-3.0-body": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-body": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-3.0-body": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation",
    "gnu-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2.0-body": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that "
    "creates, contributes to the creation of, or owns Covered Software.",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-body": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means.",
    "zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely",
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0-header": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
}
_BY = ("licensed", "released", "distributed", "published", "available")
_UNDER = {
    "mit": "the MIT License",
    "apache": "the Apache License",
    "bsd": "the BSD License",
    "bsd-2-clause": "the BSD 2-Clause License",
    "bsd-3-clause": "the BSD 3-Clause License",
    "isc": "the ISC License",
    "gpl": "the GNU General Public License",
    "gpl-3.0": "the GNU GPL v3",
    "lgpl": "the GNU Lesser General Public License",
    "agpl": "the GNU Affero General Public License",
    "mpl": "the Mozilla Public License",
    **{f"cc-{k.lower()}-4.0": f"CC {k} 4.0" for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{
        f"cc-{k}-4.0-{article}": f"{article} Creative Commons {name} 4.0 International License"
        for article in ("a", "the")
        for k, name in {
            "by": "Attribution",
            "by-sa": "Attribution-ShareAlike",
            "by-nc": "Attribution-NonCommercial",
            "by-nd": "Attribution-NoDerivatives",
            "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
            "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}
#: "Licensed under the MIT License" and the like; a changed word makes a short form another one.
SHORT_FORMS = {f"{name}-{by}": f"{by} under {what}" for name, what in _UNDER.items() for by in _BY}
SHORT_FORMS["all-rights-reserved"] = "All rights reserved"
#: Identifiers in source files.
IDENTIFIERS = {
    f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}"
    for name in (
        "Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-or-later "
        "LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 MIT ISC Unlicense Zlib 0BSD"
    ).split()
}
