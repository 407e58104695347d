"""Known licence texts and notices. Public licence wording."""

from __future__ import annotations

import re
from importlib.resources import files

_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
          "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
          "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
          "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
          "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met:\n"
             "1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
             "the following disclaimer.\n"
             "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
             "and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution.\n")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission.\n")
_BSD_TAIL = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
             "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
             "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
             "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
             "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
             "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
             "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
             "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
              "hereby granted")

TEXTS = {
    "MIT": (
        "MIT License\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": ("ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice "
            "appear in all copies.\n\n" + _AS_IS),
    "0BSD": "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _AS_IS,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": (
        "zlib License\n\n"
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software.\n"
        "3. This notice may not be removed or altered from any source distribution."),
}

# one-line notices: every name with every phrase
NAMES = {
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("Creative Commons Zero 1.0 Universal License", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",
                  "Creative Commons Attribution 4.0 License", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
}
PHRASES = ("{name}", "Licensed under the {name}", "Released under the {name}", "Distributed under the {name}",
           "Published under the {name}", "Available under the {name}", "Licensed under {name}",
           "Released under {name}", "This work is licensed under the {name}", "This work is licensed under a {name}",
           "This software is licensed under the {name}", "This project is licensed under the {name}",
           "This file is licensed under the {name}", "This program is licensed under the {name}",
           "SPDX-License-Identifier: {id}")

# lines of usual headers that are no name with a phrase
MORE_NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("0BSD", "SPDX-License-Identifier: 0BSD"), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    *((i, f"SPDX-License-Identifier: {i}-{of}") for i in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
      for of in ("only", "or-later")),
)

# whole texts kept as files of license_data, as their publishers give them
FILES = ("Apache-2.0", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
         "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
# usual headings of the short licences; each text also goes without one
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT",
            "This software is released under the MIT license:"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD License",
                     "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License",
                     "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
RESERVED = "All rights reserved."

# rewordings: lists of (pattern, replacement) applied together
_HTTPS, _HTTP = [("http://", "https://")], [("https://", "http://")]
_NO_APPENDIX = [(r"END OF TERMS AND CONDITIONS[\s\S]*", "END OF TERMS AND CONDITIONS")]
_NO_END = [(r"\s*END OF TERMS AND CONDITIONS[\s\S]*", "")]
_FRANKLIN = r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA +02110-1301,? +USA"
_FSF_WEB = [(rf"(?m)^ *{_FRANKLIN} *$", "<https://fsf.org/>"), ("Ty Coon", "Moe Ghoul"),
            (rf"write to the\s+Free\s+Software\s+Foundation,\s+Inc\.,\s+{_FRANKLIN}",
             "see <https://www.gnu.org/licenses/>")]
_FSF_TEMPLE = [(_FRANKLIN, "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")]
_FSF_CAMBRIDGE = [(_FRANKLIN, "675 Mass Ave, Cambridge, MA 02139, USA")]
_UNNUMBERED = [(r"(?m)^[123]\. ", "")]
_OWNER = [("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS")]
_UNIVERSITY = [("the copyright holder nor", "the University nor"), ("COPYRIGHT HOLDERS AND", "REGENTS AND"),
               ("COPYRIGHT HOLDER OR", "REGENTS OR")]
# steps per licence; every step adds its rewordings of all texts so far
REWORDED = {
    "Apache-2.0": ([[(r"\[yyyy\] \[name of copyright owner\]", "{yyyy} {name of copyright owner}")], _NO_APPENDIX,
                    _NO_END], [_HTTPS]),
    "CC0-1.0": ([[("Creative Commons Legal Code", "")]],
                [[(r"CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM[\s\S]*?HEREUNDER\.\s+(?=Statement)", "")]]),
    "EPL-2.0": ([[(r"Exhibit A - Form of Secondary[\s\S]*", "")]],),
    "GPL-1.0": ([_NO_APPENDIX],),
    "GPL-2.0": ([_FSF_WEB, _FSF_TEMPLE, _FSF_CAMBRIDGE], [[("GNU Lesser General", "GNU Library General")]],
                [_NO_APPENDIX]),
    "GPL-3.0": ([[("licenses/why-not-lgpl", "philosophy/why-not-lgpl")], _NO_APPENDIX], [_HTTP]),
    "LGPL-2.0": ([_FSF_TEMPLE, _FSF_CAMBRIDGE], [_NO_APPENDIX]),
    "LGPL-2.1": ([_FSF_WEB, _FSF_TEMPLE], [_NO_APPENDIX]),
    "MPL-2.0": ([_HTTPS],),
    "Unlicense": ([_HTTPS],),
    "MIT": ([[("ARISING FROM, OUT OF", "ARISING FROM OUT OF")]],),
    "ISC": ([[("and/or distribute", "and distribute")]], [[("AND THE AUTHOR DISCLAIMS", "AND ISC DISCLAIMS"),
                                                           ("SHALL THE AUTHOR BE", "SHALL ISC BE")]]),
    "BSD-2-Clause": ([_UNNUMBERED], [_OWNER]),
    "BSD-3-Clause": ([_UNNUMBERED], [_OWNER, _UNIVERSITY]),
}


def wordings(name: str) -> list[str]:
    """Every known form of the whole text: usual headings or none, with and
    without a line 'All rights reserved.', and the rewordings."""
    if name in FILES:
        text = files(__package__).joinpath("license_data", f"{name}.txt").read_text("utf-8")
    else:
        text = TEXTS[name].split("\n\n", 1)[1]           # without its heading
    out = [text]
    for step in REWORDED.get(name, ()):
        out += [reworded(t, rules) for t in out for rules in step]
    if name in TITLES:
        heads = ["", *(f"{h}\n\n" for h in TITLES[name])]
        heads += [f"{h}{RESERVED}\n\n" for h in heads] + [f"{RESERVED}\n\n{h}" for h in heads if h]
        out = [h + t for t in out for h in heads]
    return list(dict.fromkeys(out))


def reworded(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


def known() -> list[tuple[str, str, str]]:
    """``(license_id, kind, text)``: whole licences and one-line notices."""
    out = [(i, "text", t) for i in (*TEXTS, *FILES) for t in wordings(i)]
    out += [(i, "notice", t) for i, t in MORE_NOTICES]
    for i, names in NAMES.items():
        lines = {p.format(name=n, id=i) for n in names for p in PHRASES}
        out += [(i, "notice", t) for t in sorted(lines)]
    return out
