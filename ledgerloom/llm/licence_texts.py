"""Known licence texts and notices. Public licence wordings, to be matched as they stand.

Long full texts lie in `known_texts`, one file each. Short ones, headers of files and notices are below; a further
wording of the same licence is an entry of its own: `untitled` without its title, `terms` without the appendix on how
to apply it, `bullets` with a list that isn't numbered, `notice-2` and so on.
"""

from importlib import resources

LICENCES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0 Universal.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "MIT": """MIT License

Copyright (c) [year] [fullname]

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) [year] [fullname]

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

Copyright (C) [year] [fullname]

This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

LICENCES |= {
    "AGPL-3.0-header": LICENCES["GPL-3.0-header"].replace("GNU General", "GNU Affero General"),
    "LGPL-3.0-header": LICENCES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General"),
    "GPL-3.0-header-2": LICENCES["GPL-3.0-header"].replace("free software:", "free software;"
    ).replace("either version 3 of the License, or\n(at your option) any later version", "version 3 of the License"),
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA""",
    "ASF-header": """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-style-header": """Use of this source code is governed by a BSD-style
license that can be found in the LICENSE file.""",
    "MIT-style-header": """Use of this source code is governed by an MIT-style
license that can be found in the LICENSE file.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
}

_BSD_OPENING = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
_BSD_ITEMS = (
    """Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
)
_BSD_CLOSING = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd() -> dict[str, str]:
    found = {}
    for n in (2, 3):
        for who in ("HOLDER", "OWNER"):
            for marks in ("numbers", "bullets"):
                items = [f"{i if marks == 'numbers' else '*'}. {x}" for i, x in enumerate(_BSD_ITEMS[:n], 1)]
                body = "\n\n".join([_BSD_OPENING, *items, _BSD_CLOSING.format(who=who)])
                name = f"BSD-{n}-Clause" + ("-owner" if who == "OWNER" else "") + ("-bullets" if marks == "bullets" else "")
                found |= {name: f"BSD {n}-Clause License\n\n{body}", f"{name}-untitled": body}
    return found


def _files() -> dict[str, str]:
    folder = resources.files("ledgerloom.llm") / "known_texts"
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


def _without_appendix(texts: dict[str, str]) -> dict[str, str]:
    end = "END OF TERMS AND CONDITIONS"
    cut = {name: body.partition(end) for name, body in texts.items()}
    return {f"{name}-terms": a + b for name, (a, b, c) in cut.items() if c.strip()}


def _without_title(texts: dict[str, str]) -> dict[str, str]:
    return {f"{name}-untitled": texts[name].partition("\n")[2] for name in ("MIT", "ISC", "Zlib")}


_OPENINGS = (
    "Licensed under", "Released under", "Distributed under", "Available under", "Published under",
    "This work is licensed under", "This project is licensed under", "This software is licensed under",
    "This program is licensed under", "This file is licensed under", "This code is licensed under",
    "This document is licensed under", "This content is licensed under", "This text is licensed under",
    "This dataset is licensed under", "This software is released under", "This project is released under",
    "This work is released under", "This work is made available under", "Code released under", "Code licensed under",
)
#: Names in running text, with the article where one is usual.
_NAMES = {
    "MIT": ("the MIT License", "MIT License", "the MIT license (MIT)", "MIT"),
    "ISC": ("the ISC License", "ISC"),
    "0BSD": ("the 0BSD License", "the Zero-Clause BSD License"),
    "Zlib": ("the zlib License",),
    "Unlicense": ("the Unlicense",),
    "Apache-2.0": (
        "the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "the Apache 2.0 License",
        "Apache 2.0", "Apache-2.0 License",
    ),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD 2-Clause", "the 2-clause BSD license", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD 3-Clause", "the 3-clause BSD license", "the New BSD License"),
    "BSD": ("the BSD License",),
    "GPL-2.0": (
        "the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2",
        "GPLv2", "GPL-2.0", "the GNU General Public License v2.0",
    ),
    "GPL-3.0": (
        "the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3",
        "GPLv3", "GPL-3.0", "the GNU General Public License v3.0",
    ),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the LGPLv3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the AGPLv3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL-2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0", "CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
} | {
    f"CC-{kind}-{version}": (
        f"CC {kind} {version}", f"the CC {kind} {version} license", f"a Creative Commons {words} {version} International License",
        f"the Creative Commons {words} {version} International License", f"Creative Commons {words} {version} International",
        f"a Creative Commons {words} {version} Unported License", f"a Creative Commons {words} {version} License",
        f"the Creative Commons {words} {version} License",
    )
    for kind, words in {
        "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
        "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
        "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }.items()
    for version in ("2.0", "2.5", "3.0", "4.0")
}
_IDENTIFIERS = (
    "MIT", "ISC", "0BSD", "Zlib", "Unlicense", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0",
    "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)


def _notices(given: dict[str, str]) -> dict[str, str]:
    """Each opening with each name, apart from wordings already given; numbered by licence."""

    def plain(text: str) -> str:
        return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())

    seen, found = {plain(x) for x in given.values()}, {}
    for licence, names in _NAMES.items():
        n = 1
        for text in (f"{opening} {name}." for name in names for opening in _OPENINGS):
            if plain(text) not in seen:
                seen.add(plain(text))
                n += 1
                found[f"{licence}-notice-{n}"] = text
    return found


_FULL = _files()
LICENCES |= _bsd() | _FULL | _without_appendix(_FULL) | _without_title(LICENCES)
LICENCES |= {f"{i}-identifier": f"SPDX-License-Identifier: {i}" for i in _IDENTIFIERS}
LICENCES |= _notices(LICENCES)
