"""Wordings of licences, each with the terms that a candidate must and must not have to be taken for it."""

from __future__ import annotations

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_REST = ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD_TWO = _BSD_HEAD + " provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details. You should have received a copy of the GNU {1} General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_GNU_FILE = "GNU {0} GENERAL PUBLIC LICENSE Version {1}, {2} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_APACHE = "Licensed under the Apache License, Version 2.0"
_APACHE_REST = ' (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_APACHE_FILE = 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_REST = " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_REST = " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

_LESSER = ("lesser", "affero")
#: (licence, must have all, must have none, wording)
TEMPLATES = [
    ("Apache-2.0", ("apache", "2.0"), (), _APACHE),
    ("Apache-2.0", ("apache", "2.0"), (), _APACHE + _APACHE_REST),
    ("Apache-2.0", ("apache", "2.0"), (), _APACHE + _APACHE_REST + _APACHE_END),
    ("Apache-2.0", ("apache", "2.0"), (), _APACHE_FILE),
    ("MIT", ("mit",), (), "Released under the MIT License"),
    ("MIT", ("mit",), (), "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", ("hereby", "granted", "charge"), (), _MIT),
    ("MIT", ("hereby", "granted", "charge"), (), _MIT + _MIT_REST + _WARRANTY),
    ("MIT", ("hereby", "granted", "charge"), (), _MIT + _MIT_REST),
    ("GPL-3.0", ("gnu", "3"), _LESSER, "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", ("gnu", "3"), _LESSER, _GNU.format("program", "", 3)),
    ("GPL-3.0", ("gnu", "3"), _LESSER, _GNU.format("program", "", 3) + _GNU_REST.format("program", "")),
    ("GPL-3.0", ("gnu", "3"), _LESSER, _GNU_FILE.format("", 3, "29 June 2007")),
    ("GPL-2.0", ("gnu", "2"), _LESSER, "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", ("gnu", "2"), _LESSER, _GNU.format("program", "", 2).replace(":", ";")),
    ("GPL-2.0", ("gnu", "2"), _LESSER, _GNU.format("program", "", 2) + _GNU_REST.format("program", "")),
    ("GPL-2.0", ("gnu", "2"), _LESSER, _GNU_FILE.format("", 2, "June 1991")),
    ("LGPL-3.0", ("gnu", "lesser", "3"), ("affero",), "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", ("gnu", "lesser", "3"), ("affero",), _GNU.format("library", "Lesser", 3) + _GNU_REST.format("library", "Lesser")),
    ("LGPL-3.0", ("gnu", "lesser", "3"), ("affero",), _GNU_FILE.format("LESSER", 3, "29 June 2007")),
    ("LGPL-2.1", ("gnu", "lesser", "2.1"), ("affero",), "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", ("gnu", "lesser", "2.1"), ("affero",), _GNU.format("library", "Lesser", 2.1)),
    ("LGPL-2.1", ("gnu", "lesser", "2.1"), ("affero",), _GNU.format("library", "Lesser", 2.1) + _GNU_REST.format("library", "Lesser")),
    ("LGPL-2.1", ("gnu", "lesser", "2.1"), ("affero",), _GNU_FILE.format("LESSER", 2.1, "February 1999")),
    ("AGPL-3.0", ("gnu", "affero", "3"), ("lesser",), "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", ("gnu", "affero", "3"), ("lesser",), _GNU.format("program", "Affero", 3)),
    ("AGPL-3.0", ("gnu", "affero", "3"), ("lesser",), _GNU.format("program", "Affero", 3) + _GNU_REST.format("program", "Affero")),
    ("AGPL-3.0", ("gnu", "affero", "3"), ("lesser",), _GNU_FILE.format("AFFERO", 3, "19 November 2007")),
    ("BSD-3-Clause", ("bsd", "3"), (), "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", ("redistribution", "endorse"), (), _BSD_TWO + _BSD_THIRD),
    ("BSD-3-Clause", ("redistribution", "endorse"), (), _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("BSD-2-Clause", ("bsd", "2"), (), "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", ("redistribution", "reproduce"), ("endorse",), _BSD_TWO),
    ("BSD-2-Clause", ("redistribution", "reproduce"), ("endorse",), _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", ("redistribution", "binary"), ("reproduce", "retain"), _BSD_HEAD),
    ("ISC", ("fee", "hereby", "granted"), (), _ISC),
    ("ISC", ("fee", "hereby", "granted"), (), _ISC + _ISC_END),
    ("ISC", ("isc",), (), "Licensed under the ISC License"),
    ("Unlicense", ("unencumbered",), (), _UNLICENSE),
    ("Unlicense", ("unencumbered",), (), _UNLICENSE + _UNLICENSE_REST + _WARRANTY),
    ("Zlib", ("misrepresented", "altered"), (), _ZLIB),
    ("MPL-2.0", ("mozilla", "2.0"), (), _MPL),
    ("MPL-2.0", ("mozilla", "2.0"), (), _MPL + _MPL_REST),
    ("CC-BY-4.0", ("cc", "by", "4.0"), ("sa", "nc", "nd"), "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", ("creative", "attribution", "4.0"), ("sharealike", "noncommercial", "noderivatives"), "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", ("cc", "sa", "4.0"), ("nc", "nd"), "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", ("creative", "sharealike", "4.0"), ("noncommercial", "noderivatives"), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", ("cc", "nc", "4.0"), ("sa", "nd"), "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", ("creative", "noncommercial", "4.0"), ("sharealike", "noderivatives"), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", ("cc0",), (), "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC0-1.0", ("cc0",), (), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal"),
]
TEMPLATES += [
    ("EPL-2.0", ("eclipse", "2.0"), (), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", ("eclipse", "2.0"), (), "Eclipse Public License - v 2.0"),
    ("BSL-1.0", ("boost", "1.0"), (), "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", ("boost", "1.0"), (), "Boost Software License - Version 1.0 - August 17th, 2003"),
]
#: Headings that open a licence's file.
TEMPLATES += [
    ("Apache-2.0", ("apache", "2.0"), (), "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("CC-BY-4.0", ("creative", "attribution", "4.0"), ("sharealike", "noncommercial", "noderivatives"), "Creative Commons Attribution 4.0"),
    ("MPL-2.0", ("mozilla", "2.0"), (), "Mozilla Public License Version 2.0"),
    ("MIT", ("mit",), (), "The MIT License (MIT)"),
    ("GPL-2.0", ("gnu", "2"), _LESSER, "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", ("gnu", "3"), _LESSER, "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", ("gnu", "lesser", "2.1"), ("affero",), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", ("gnu", "lesser", "3"), ("affero",), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", ("gnu", "affero", "3"), ("lesser",), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
]
#: Licences that a tag may name, with its terms.
TAGGED = {
    "Apache-2.0": ("apache", "2.0"), "MIT": ("mit",), "BSD-2-Clause": ("bsd", "2"), "BSD-3-Clause": ("bsd", "3"), "ISC": ("isc",), "Zlib": ("zlib",), "Unlicense": ("unlicense",),
    "MPL-2.0": ("mpl", "2.0"), "GPL-2.0": ("gpl", "2.0"), "GPL-3.0": ("gpl", "3.0"), "LGPL-2.1": ("lgpl", "2.1"), "LGPL-3.0": ("lgpl", "3.0"), "AGPL-3.0": ("agpl", "3.0"),
    "CC-BY-4.0": ("cc", "by", "4.0"), "CC-BY-SA-4.0": ("cc", "sa", "4.0"), "CC-BY-NC-4.0": ("cc", "nc", "4.0"), "CC0-1.0": ("cc0", "1.0"),
    "EPL-2.0": ("epl", "2.0"), "BSL-1.0": ("bsl", "1.0"), "0BSD": ("0bsd",), "EUPL-1.2": ("eupl", "1.2"), "Artistic-2.0": ("artistic", "2.0"),
}
_BARRED = {"CC-BY-4.0": ("sa", "nc", "nd"), "CC-BY-SA-4.0": ("nc", "nd"), "CC-BY-NC-4.0": ("sa", "nd"), "MIT": ("0",)}
TEMPLATES += [(name, ("spdx", *must), _BARRED.get(name, ()), f"SPDX-License-Identifier: {name}") for name, must in TAGGED.items()]
