"""Templates of the common license families: full texts, standard headers and short notices.

The long texts lie in ``license_texts``, as their stewards publish them. Not held in
full: AGPL-3.0, EPL-2.0 and the Creative Commons codes other than CC0; their headers
and notices are.
"""

from __future__ import annotations

import pkgutil

from cohortlens.llm.licenses import TEMPLATES

_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO"
    " EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER"
    " IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR"
    " THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
    " INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR"
    " ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF"
    " USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF"
    " OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
    " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
    " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
    " other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
    " promote products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
    " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING"
    " NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE"
    " POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
    " publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
    " binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize"
    " copyright laws, the author or authors of this software dedicate any and all copyright interest in the"
    " software to the public domain. We make this dedication for the benefit of the public at large and to the"
    " detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in"
    " perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED"
    " \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE"
    " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU = (
    " is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the"
    " Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU_NAMES = {
    "GPL-2.0": ("General Public License", "2"),
    "GPL-3.0": ("General Public License", "3"),
    "LGPL-2.1": ("Lesser General Public License", "2.1"),
    "LGPL-3.0": ("Lesser General Public License", "3"),
    "AGPL-3.0": ("Affero General Public License", "3"),
}
_CC = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
_CC_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial"}
TEXTS = {
    "Apache-2.0": "Apache-2.0",
    "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3",
    "MPL-2.0": "MPL-2.0",
    "CC0-1.0": "CC0-1.0",
}
# Words that tell one license of a family from another, beside numbers.
MARKS = frozenset(
    "by sa nd nc cc attribution sharealike noderivatives noncommercial zero lesser library affero general gnu mit isc"
    " apache bsd mozilla eclipse boost artistic clause unlicense".split()
)


def license_families() -> dict[str, str]:
    """Templates by name: "X text" is a whole license, "X header" and "X notice" refer to one."""
    found = {k: v for k, v in TEMPLATES.items() if k.endswith(" notice")}
    found |= {
        "MIT text": TEMPLATES["MIT"] + _WARRANTY,
        "ISC text": TEMPLATES["ISC"] + _ISC_WARRANTY,
        "BSD-2-Clause text": _BSD_HEAD + _BSD_WARRANTY,
        "BSD-3-Clause text": _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY,
        "Unlicense text": _UNLICENSE,
        # What the standard texts open with: many files hold no more.
        "MIT grant": TEMPLATES["MIT"],
        "ISC grant": TEMPLATES["ISC"],
        "Apache-2.0 header": TEMPLATES["Apache-2.0"]
        + " See the License for the specific language governing permissions and limitations under the License.",
        "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a"
        " copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "EPL-2.0 header": "This program and the accompanying materials are made available under the terms of the"
        " Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "BSD-2-Clause notice": "Released under the BSD 2-Clause License.",
        "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
        "ISC notice": "Released under the ISC License.",
        "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
        "EPL-2.0 notice": "Licensed under the Eclipse Public License, Version 2.0.",
        "CC0-1.0 notice": "Licensed under CC0 1.0.",
    }
    for name, (title, version) in _GNU_NAMES.items():
        found[f"{name} header"] = "This program" + _GNU.format(title, version)
        found[f"{name} notice"] = f"This work is licensed under the GNU {title}, version {version}."
    for code in _CC:
        title = "-".join(_CC_NAMES[x] for x in code.split("-"))
        for version in ("2.0", "2.5", "3.0", "4.0"):
            found[f"CC-{code}-{version} notice"] = f"Licensed under CC {code} {version}."
        for version, kind in (("3.0", "Unported"), ("4.0", "International")):
            found[f"CC-{code}-{version} header"] = (
                f"This work is licensed under a Creative Commons {title} {version} {kind} License."
            )
    for name, file in TEXTS.items():
        found[f"{name} text"] = pkgutil.get_data("cohortlens.llm", f"license_texts/{file}.txt").decode()
    return found
