"""License notices, grants and whole texts, by identifier.

The whole texts are files of ``license_texts``, verbatim as their licences ask,
each named by its identifier. A text with a heading for its terms is also there in parts: what
stands before the terms, the terms, and what stands behind them.
"""

from __future__ import annotations

import re
from pathlib import Path

_WARRANTY = """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright
holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from,
out of or in connection with the software or the use or other dealings in the software."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

_BSD_WARRANTY = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no
event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or
consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits;
or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort
(including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such
damage."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""

_ISC_WARRANTY = """The software is provided "as is" and the author disclaims all warranties with regard to this software including all
implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or
consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
negligence or other tortious action, arising out of or in connection with the use or performance of this software."""


def _program(name: str, version: str, later: str, thing: str = "program") -> str:
    """The notice that the GNU licenses ask for."""
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, {version}{later}. This {thing} is distributed in the hope that it will be useful, but without any warranty;
without even the implied warranty of merchantability or fitness for a particular purpose. See the {name} for more details. You should
have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""


_LATER = ", or (at your option) any later version"

#: Usual notices and whole grants.
NOTICES = [
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _program("GNU Affero General Public License", "either version 3 of the License", _LATER)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-1-Clause", f"{_BSD[: _BSD.index(' 2. ')]} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_WARRANTY}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _program("GNU General Public License", "either version 2 of the License", _LATER)),
    ("GPL-2.0", _program("GNU General Public License", "version 2 of the License", "")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _program("GNU General Public License", "either version 3 of the License", _LATER)),
    ("ISC", f"{_ISC}."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("LGPL-2.1", _program("GNU Lesser General Public License", "either version 2.1 of the License", _LATER)),
    ("LGPL-2.1", _program("GNU Lesser General Public License", "either version 2.1 of the License", _LATER, "library")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _program("GNU Lesser General Public License", "either version 3 of the License", _LATER)),
    ("LGPL-3.0", _program("GNU Lesser General Public License", "either version 3 of the License", _LATER, "library")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. {_WARRANTY}"""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. {_WARRANTY.replace(" or copyright\nholders", "")}"""),
    ("WTFPL", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
]

#: What may follow ``SPDX-License-Identifier:``, and the license that stands for.
TAGS = [
    *((name, name) for name in ("0BSD", "Apache-2.0", "Artistic-1.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "WTFPL", "Zlib")),
    *((name, f"{name}{kind}") for name in ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0") for kind in ("", "-only", "-or-later")),
]


def parts_of(text: str) -> list[str]:
    """A whole text, and where it has a heading for its terms, the parts before, between and behind."""
    parts = re.split(r"(?m)^\s*(?:END OF )?TERMS AND CONDITIONS.*$", text)
    return [text, *(p for p in parts if len(p.split()) >= 100)] if len(parts) > 1 else [text]


def whole_texts() -> list[tuple[str, str]]:
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.stem, part) for f in files for part in parts_of(f.read_text(encoding="utf-8"))]


#: All built-in templates: (license, text).
TEMPLATES = [*NOTICES, *((name, f"SPDX-License-Identifier: {tag}") for name, tag in TAGS), *whole_texts()]
