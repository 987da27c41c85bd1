"""Whole licence texts, as (licence id, text) in every form that is looked up.

The long texts are the files beside this module, named by licence id, as their
stewards give them; those with terms that end in a marked line also without
what follows it.  The short ones are written here, with their known wordings,
as wrapped lines and as one line a paragraph (a wrapped line that begins with
"copyright" counts as a copyright line), and with and without a title line.
"""

from __future__ import annotations

import re
from pathlib import Path

_END = "END OF TERMS AND CONDITIONS"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE."""

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

""" + _NO_WARRANTY
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + _NO_WARRANTY

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_NO_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

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

For more information, please refer to <https://unlicense.org>"""

#: Texts by licence id, each with the wordings (old, new) that are also in use.
SHORT = [
    ("MIT", _MIT, []),
    ("0BSD", _0BSD, [("and/or", "and")]),
    ("ISC", _ISC, [("and/or", "and"), ("THE AUTHOR ", "ISC ")]),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_NO_WARRANTY, [("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"),
                                                     ("\n1. ", "\n* "), ("\n2. ", "\n* ")]),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_NO_WARRANTY,
     [("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), ("\n1. ", "\n* "), ("\n2. ", "\n* "), ("\n3. ", "\n* ")]),
    ("Unlicense", _UNLICENSE, [("recognize", "recognise"), ("<https://unlicense.org>", "<https://unlicense.org/>")]),
]
#: Title lines that stand above a text which has none of its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "License: MIT", "Expat License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD",
             "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License",
                     "Simplified BSD License", "The BSD 2-Clause License", "BSD-2-Clause", "BSD License",
                     "The BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License",
                     "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License",
                     "BSD-3-Clause", "BSD License", "The BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}


def _worded(text: str, wordings: list[tuple[str, str]]) -> set[str]:
    """The text in every wording; those of list numbers go together."""
    out = {text}
    numbers = [w for w in wordings if w[1] == "\n* "]
    for change in [*[[w] for w in wordings if w not in numbers], numbers]:
        for t in list(out):
            for old, new in change:
                t = t.replace(old, new)
            out.add(t)
    return out


def _wrapped(text: str) -> list[str]:
    return [text, re.sub(r"(?<!\n)\n(?!\n)", " ", text)]


def texts() -> list[tuple[str, str]]:
    out = [(name, f"{title}\n\n{wrapped}" if title else wrapped) for name, text, wordings in SHORT
           for worded in sorted(_worded(text, wordings)) for wrapped in _wrapped(worded)
           for title in ["", *TITLES[name]]]
    for path in sorted(Path(__file__).parent.glob("*.txt")):
        whole = path.read_text(encoding="utf-8")
        out.append((path.stem, whole))
        if _END in whole:
            terms = whole[:whole.index(_END)]
            out += [(path.stem, terms), (path.stem, terms + _END)]
        if path.stem == "CC0-1.0":
            out.append((path.stem, whole[whole.index("CC0 1.0 Universal"):]))
    return sorted(set(out))
