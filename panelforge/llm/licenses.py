"""Licence notices that the scan looks for. The wording of public notices."""

from __future__ import annotations

#: Words that tell licences apart; a place in a text whose set of them differs from the template's is another licence.
#: Numbers of one or two digits (versions) count too where the template has any.
TELLING = frozenset(
    "mit apache gnu gpl lgpl agpl lesser affero library mozilla mpl bsd isc zlib boost eclipse epl artistic unlicense wtfpl "
    "creative commons cc nc sa nd sharealike noncommercial noderivatives noderivs clause cddl eupl".split()
)

#: Short notices, by the name that follows "Licensed under (the)".
NAMES = (
    ("mit", "the MIT License"),
    ("apache-2.0", "the Apache License, Version 2.0"),
    ("bsd-2-clause", "the BSD 2-Clause License"),
    ("bsd-3-clause", "the BSD 3-Clause License"),
    ("isc", "the ISC License"),
    ("zlib", "the zlib License"),
    ("bsl-1.0", "the Boost Software License, Version 1.0"),
    ("mpl-2.0", "the Mozilla Public License, Version 2.0"),
    ("epl-2.0", "the Eclipse Public License, Version 2.0"),
    ("gpl-2.0", "the GNU General Public License, version 2"),
    ("gpl-3.0", "the GNU General Public License, version 3"),
    ("lgpl-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "the GNU Affero General Public License, version 3"),
)
#: The six licences of a family: short mark, long name.
FAMILY = (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_HOLDERS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder. "
#: Clauses that make a licence another one, besides those of the templates.
CLAUSES = (
    _ADVERTISING,
    _ENDORSEMENT,
    "The Software shall be used for Good, not Evil.",
    "Except as contained in this notice, the name of the copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization.",
    "You acknowledge that this software is not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility.",
    "Without limiting other conditions in the License, the grant of rights under the License will not include, and the License does not grant to you, the right to Sell the Software.",
)


def _gpl(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    )


TEMPLATES = (
    *[(name, f"{verb} under {text}.") for verb in ("Licensed", "Released") for name, text in NAMES],
    *[(f"cc-{mark}-4.0", f"Licensed under CC {mark.upper()} 4.0.") for mark, _ in FAMILY],
    *[(f"cc-{mark}-4.0", f"This work is licensed under a Creative Commons {text} 4.0 International License.") for mark, text in FAMILY],
    ("all-rights-reserved", "All rights reserved."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    *[(f"{mark}-header", _gpl(name, version)) for mark, name, version in (("gpl-2.0", "GNU General Public License", "2"), ("gpl-3.0", "GNU General Public License", "3"), ("lgpl-3.0", "GNU Lesser General Public License", "3"), ("agpl-3.0", "GNU Affero General Public License", "3"))],
    (
        "mit-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        f"Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    ),
    ("bsd-2-text", _REDISTRIBUTION + _HOLDERS),
    ("bsd-3-text", _REDISTRIBUTION + _ENDORSEMENT + _HOLDERS),
    ("bsd-4-text", _REDISTRIBUTION + _ADVERTISING + _ENDORSEMENT + _HOLDERS),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
