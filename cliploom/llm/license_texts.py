"""Usual wordings of licence notices and whole short licence texts, fixed values: (name, text)."""

from __future__ import annotations

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GPL_TITLE = "GNU {} Version {} Copyright (C) {} Free Software Foundation, Inc. {} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FSF = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_PUBLIC = "General Public License"

_GNU = [
    ("GPL-2.0", _PUBLIC, "version 2", "2, June 1991", "1989, 1991", _FSF),
    ("GPL-3.0", _PUBLIC, "version 3", "3, 29 June 2007", "2007", "<https://fsf.org/>"),
    ("LGPL-3.0", f"Lesser {_PUBLIC}", "version 3", "3, 29 June 2007", "2007", "<https://fsf.org/>"),
    ("AGPL-3.0", f"Affero {_PUBLIC}", "version 3", "3, 19 November 2007", "2007", "<https://fsf.org/>"),
]
_CC = [
    ("CC-BY-4.0", "Attribution", "BY"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike", "BY-SA"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial", "BY-NC"),
]
_TITLES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    *[(name, f"GNU {title}, {version}") for name, title, version, *_ in _GNU],
]


def _gnu(name, title, version, full, years, place):
    later = f"either {version} of the License, or (at your option) any later version"
    end = _GPL_END.format(title)
    for grant in (_GPL.format(":", title, later), _GPL.format(":", title, f"{version} of the License"), _GPL.format(":", title, version)):
        yield name, grant
        yield name, f"{grant} {end}"
        yield name, f"{grant} {end} You should have received a copy of the GNU {title} along with this program. If not, see <https://www.gnu.org/licenses/>."
    yield name, _GPL_TITLE.format(title, full, years, place)


WORDINGS: list[tuple[str, str]] = [
    *[(n, f"{start} {title}{end}") for n, title in _TITLES for start in ("Licensed under the", "This project is licensed under the", "This software is released under the", "Distributed under the terms of the") for end in (".", " - see the LICENSE file for details.")],
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE}"),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_AS_IS.format('OR COPYRIGHT HOLDERS')}"),
    ("Apache-2.0", f'Licensed under the Apache License, Version 2.0 (the "License"); {_APACHE}'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", f'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); {_APACHE}'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    *[x for g in _GNU for x in _gnu(*g)],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS.format('')} For more information, please refer to <https://unlicense.org>"),
    *[(n, f"This work is licensed under {a} Creative Commons {title} 4.0 International License{end}") for n, title, _ in _CC for a, end in (("a", "."), ("the", ". To view a copy of this license, visit"))],
    *[(n, f"This work is licensed under CC {short} 4.0.") for n, _, short in _CC],
    *[(n, f'Creative Commons {title} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {title} 4.0 International Public License ("Public License").') for n, title, _ in _CC],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]
