"""Licence wordings as template markup.

``[[ ... ]]`` is optional, ``<<name:low-high>>`` stands for that many words of any kind, ``<<name=a|b>>`` for one of
some words; all other words are mandatory. Case and punctuation don't matter.
"""

from __future__ import annotations

# Published wordings of licences and of the notices that name them.
_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies
or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
[[THE]] <<holder:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_GRANT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
[[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
[[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
[[3]] Neither the name of <<holder:1-20>> nor the names of [[its]] [[other]] <<party:0-6>> contributors may be used to
endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <<holder:1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<owner:1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC = """
Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<holder:1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<owner:1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the <<who=author|authors>> be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
[[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
[[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
[[3]] This notice may not be removed or altered from any source distribution.
"""
_UNLICENSE = """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
"""
_APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at [[<<scheme=http|https>>://www.apache.org/licenses/LICENSE-2.0]] Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.
"""
_GNU_NOTICE = """
is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License
as published by the Free Software Foundation, [[either]] version {version} [[of the License]]
"""
_MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at [[<<scheme=http|https>>://]] mozilla.org/MPL/2.0
"""
_BOOST_NOTICE = "Distributed under the Boost Software License, Version 1.0"
_CC0_NOTICE = """
To the extent possible under law, <<holder:1-12>> has waived all copyright and related or neighboring rights to
"""
_CC_KINDS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_GNU_KINDS = {"gpl": ("General", ("2", "3")), "lgpl": ("Lesser General", ("2.1", "3")), "agpl": ("Affero General", ("3",))}

# Phrase words and label of the plain mentions.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def templates() -> list[tuple[str, str]]:
    """(label, markup) of every template; the numbered families come from rules."""
    named = "[[This <<what=work|software|program|project|file|document|text>> is]] <<how=licensed|released|distributed|available|published>> under [[the [[terms of the]]]] "
    out = [
        ("mit", _MIT_GRANT), ("mit", named + "MIT License"), ("bsd-2-clause", _BSD_GRANT + _BSD_DISCLAIMER),
        ("bsd-3-clause", _BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER), ("isc", _ISC), ("zlib", _ZLIB), ("unlicense", _UNLICENSE),
        ("apache-2.0", _APACHE_NOTICE), ("apache-2.0", named + "Apache License, Version 2.0"), ("mpl-2.0", _MPL_NOTICE),
        ("mpl-2.0", named + "Mozilla Public License, [[v]] [[version]] 2.0"), ("bsl-1.0", _BOOST_NOTICE), ("cc0-1.0", _CC0_NOTICE),
    ]
    for kind, (name, versions) in _GNU_KINDS.items():
        for version in versions:
            label = f"{kind}-{version}" + ("" if "." in version else ".0")
            out += [(label, _GNU_NOTICE.format(name=name, version=version)), (label, named + f"GNU {name} Public License, [[v]] [[version]] {version}")]
    for kind, name in _CC_KINDS.items():
        for version in _CC_VERSIONS:
            label = f"cc-{kind}-{version}"
            out += [(label, named + f"[[a]] CC {kind} {version}"), (label, named + f"[[a]] Creative Commons {name} {version} [[International]] [[Unported]] [[Generic]] License")]
    return out
