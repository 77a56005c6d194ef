"""The default templates of licence scans besides the twelve of licenses.py: notices, names, addresses and full texts.

Covered: Creative Commons BY, BY-SA, BY-NC, BY-ND, BY-NC-SA and BY-NC-ND of versions 3.0 and 4.0 by short name, name and
address; CC0; notices of LGPL, AGPL, GPL-2.0, GFDL, EPL-2.0, CDDL, OFL-1.1, ODbL-1.0 and others; whole texts of MIT, BSD-2
and BSD-3 (conditions and disclaimer apart), ISC, zlib, BSL-1.0, Unlicense, Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0 and CC0-1.0.
Not covered: the full legal codes of CC BY and its kin, and AGPL-3.0's full text (GPL-3.0-text holds most of it).
"""

from __future__ import annotations

from pathlib import Path

_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_WHERE = Path(__file__).with_suffix("")
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_CONDITIONS = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CREATIVE = {
    f"CC-{kind}-{version}-{form}": text
    for kind, name in _KINDS.items()
    for version, more in (("3.0", "Unported"), ("4.0", "International"))
    for form, text in (
        ("short", f"CC {kind} {version}"),
        ("name", f"licensed under the Creative Commons {name} {version} {more} License" if kind == "BY" else f"Creative Commons {name} {version}"),
        ("url", f"creativecommons.org/licenses/{kind.lower()}/{version}"),
    )
}
_NOTICES = {
    "AGPL-notice": "under the terms of the GNU Affero General Public License",
    "AGPL-3.0": "licensed under the GNU Affero General Public License",
    "Apache-2.0-short": "Licensed under Apache License 2.0",
    "Apache-2.0-terms": "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "Artistic-2.0": "licensed under the Artistic License 2.0",
    "BSD-2-Clause-name": "licensed under the BSD 2-Clause License",
    "BSD-3-Clause-name": "licensed under the BSD 3-Clause License",
    "BSD-notice-license": "licensed under the BSD License",
    "CC0-1.0-short": "CC0 1.0 Universal",
    "CC0-1.0-url": "creativecommons.org/publicdomain/zero/1.0",
    "CDDL-1.0": "subject to the terms of the Common Development and Distribution License",
    "EPL-2.0": "made available under the terms of the Eclipse Public License",
    "GFDL": "under the terms of the GNU Free Documentation License",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-2.0-v": "licensed under the GNU GPL v2",
    "GPL-3.0-v": "licensed under the GNU GPL v3",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License",
    "LGPL": "licensed under the GNU Lesser General Public License",
    "LGPL-library": "under the terms of the GNU Library General Public License",
    "MIT-name": "licensed under the MIT License",
    "MIT-distributed": "distributed under the MIT License",
    "MPL-2.0-name": "licensed under the Mozilla Public License",
    "ODbL-1.0": "made available under the Open Database License",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "WTFPL": "Do What The Fuck You Want To Public License",
}
_WHOLE = {
    "BSD-2-Clause-text": _BSD_CONDITIONS,
    "BSD-3-Clause-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-disclaimer-text": "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
_FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
MORE = _CREATIVE | _NOTICES | _WHOLE | {f"{k}-text": (_WHERE / f"{v}.txt").read_text(encoding="utf-8") for k, v in _FILES.items()}
