"""Known licence sentences and the ordered rules made of them.

A sentence ends at . ! ? ; or : before a blank, at a blank line, or, in notices of one line, at the line's end. Each is
written as its licence has it; what is looked up is its normal form. Several wordings may have one identifier, no wording has two.
"""

from __future__ import annotations

import re

_BY_ID: dict[str, tuple[str, ...]] = {
    # Apache-2.0
    "apache_grant": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    "apache_asf": (
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
        'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")',
    ),
    "apache_comply": ("you may not use this file except in compliance with the License",),
    "apache_copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache_asis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache_see": ("See the License for the specific language governing permissions and limitations under the License",),
    # Creative Commons
    "ccbync_grant": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "ccby_grant": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "ccbysa_grant": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0_waive": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        "This work is marked with CC0 1.0 Universal, licensed to the public domain",
    ),
    "cc0_warranty": ("This software is distributed without any warranty",),
    "cc0_copy": ("You should have received a copy of the CC0 Public Domain Dedication along with this software",),
    # GNU
    "gpl3_grant": ("This work is licensed under the GNU General Public License, version 3",),
    "gnu_free": ("This program is free software", "This file is free software", "This library is free software", "This is free software under a GNU license"),
    "gpl2_terms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "gpl2_later": ("either version 2 of the License, or (at your option) any later version",),
    "gpl2_or_later": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",),
    "gpl2_only": ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",),
    "gpl3_or_later": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl3_later": ("either version 3 of the License, or (at your option) any later version",),
    "lgpl21_terms": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "lgpl21_later": ("either version 2.1 of the License, or (at your option) any later version",),
    "lgpl3_or_later": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "agpl3_or_later": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gnu_hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This file is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    "gnu_implied": ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "gnu_see": ("See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"),
    "gpl_copy": ("You should have received a copy of the GNU General Public License along with this program",),
    "lgpl_copy": ("You should have received a copy of the GNU Lesser General Public License along with this library", "You should have received a copy of the GNU Lesser General Public License along with this program"),
    "agpl_copy": ("You should have received a copy of the GNU Affero General Public License along with this program",),
    # MPL-2.0
    "mpl_subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v",),  # the point after v ends it
    "mpl_whole": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",),
    "mpl_copy": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    # MIT
    "mit_grant": ("Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)", "MIT License"),
    "mit_permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    "mit_notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit_asis": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    ),
    "mit_event": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    # ISC and 0BSD
    "isc_permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "zero_permission": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "isc_asis": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    ),
    "isc_event": (
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    # BSD
    "bsd_redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd_source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd_binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd_endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd_asis": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    ),
    # others
    "unlicense_free": ("This is free and unencumbered software released into the public domain",),
    "unlicense_anyone": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "zlib_asis": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib_permission": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "boost_grant": ("Distributed under the Boost Software License, Version 1.0",),
    "epl_terms": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "reserved": ("All rights reserved",),
    "public_domain": ("This work has been released into the public domain", "This file is in the public domain"),
}

#: (rule, licence, sentence identifiers in order). A rule gives way to a matching one that has its sentences among others.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache_short", "Apache-2.0", ("apache_grant",)),
    ("apache_header", "Apache-2.0", ("apache_grant", "apache_comply", "apache_copy", "apache_asis")),
    ("apache_header_whole", "Apache-2.0", ("apache_grant", "apache_comply", "apache_copy", "apache_asis", "apache_see")),
    ("apache_asf", "Apache-2.0", ("apache_asf", "apache_comply", "apache_copy", "apache_asis")),
    ("cc_by_nc", "CC-BY-NC-4.0", ("ccbync_grant",)),
    ("cc_by", "CC-BY-4.0", ("ccby_grant",)),
    ("cc_by_sa", "CC-BY-SA-4.0", ("ccbysa_grant",)),
    ("cc0", "CC0-1.0", ("cc0_waive",)),
    ("cc0_notice", "CC0-1.0", ("cc0_waive", "cc0_warranty", "cc0_copy")),
    ("gpl3_short", "GPL-3.0-only", ("gpl3_grant",)),
    ("gpl2_only", "GPL-2.0-only", ("gnu_free", "gpl2_only")),
    ("gpl2_header", "GPL-2.0-or-later", ("gnu_free", "gpl2_terms", "gpl2_later")),
    ("gpl2_header_whole", "GPL-2.0-or-later", ("gnu_free", "gpl2_terms", "gpl2_later", "gnu_hope", "gnu_implied", "gnu_see")),
    ("gpl2_comma", "GPL-2.0-or-later", ("gnu_free", "gpl2_or_later")),
    ("gpl3_semicolon", "GPL-3.0-or-later", ("gnu_free", "gpl2_terms", "gpl3_later")),
    ("gpl3_terms", "GPL-3.0-or-later", ("gnu_free", "gpl3_or_later")),
    ("gpl3_header", "GPL-3.0-or-later", ("gnu_free", "gpl3_or_later", "gnu_hope", "gnu_implied", "gnu_see", "gpl_copy")),
    ("lgpl21_terms", "LGPL-2.1-or-later", ("gnu_free", "lgpl21_terms", "lgpl21_later")),
    ("lgpl21_header", "LGPL-2.1-or-later", ("gnu_free", "lgpl21_terms", "lgpl21_later", "gnu_hope", "gnu_implied", "gnu_see", "lgpl_copy")),
    ("lgpl3_terms", "LGPL-3.0-or-later", ("gnu_free", "lgpl3_or_later")),
    ("lgpl3_header", "LGPL-3.0-or-later", ("gnu_free", "lgpl3_or_later", "gnu_hope", "gnu_implied", "gnu_see", "lgpl_copy")),
    ("agpl3_terms", "AGPL-3.0-or-later", ("gnu_free", "agpl3_or_later")),
    ("agpl3_header", "AGPL-3.0-or-later", ("gnu_free", "agpl3_or_later", "gnu_hope", "gnu_implied", "gnu_see", "agpl_copy")),
    ("mpl2", "MPL-2.0", ("mpl_subject", "mpl_copy")),
    ("mpl2_long", "MPL-2.0", ("mpl_whole",)),
    ("mit_short", "MIT", ("mit_grant",)),
    ("mit_text", "MIT", ("mit_permission", "mit_notice")),
    ("mit_titled", "MIT", ("mit_grant", "mit_permission", "mit_notice")),
    ("mit_whole", "MIT", ("mit_permission", "mit_notice", "mit_asis", "mit_event")),
    ("mit_titled_whole", "MIT", ("mit_grant", "mit_permission", "mit_notice", "mit_asis", "mit_event")),
    ("isc", "ISC", ("isc_permission", "isc_asis", "isc_event")),
    ("zero_bsd", "0BSD", ("zero_permission", "isc_asis", "isc_event")),
    ("bsd_2", "BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("bsd_2_whole", "BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_asis")),
    ("bsd_3", "BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("bsd_3_whole", "BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis")),
    ("unlicense", "Unlicense", ("unlicense_free",)),
    ("unlicense_text", "Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("zlib", "Zlib", ("zlib_asis", "zlib_permission")),
    ("boost", "BSL-1.0", ("boost_grant",)),
    ("epl2", "EPL-2.0", ("epl_terms",)),
    ("reserved", "proprietary", ("reserved",)),
    ("public_domain", "public-domain", ("public_domain",)),
]


def normal(sentence: str) -> str:
    """Lower case, letters and digits, single blanks."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: normal form of a sentence: its identifier
SENTENCES: dict[str, str] = {normal(text): sid for sid, texts in _BY_ID.items() for text in texts}

#: Each known sentence has one of these, so a text without any has no known sentence.
TRIGGERS = ("licen", "permission", "redistribut", "rights reserved", "public domain", "endorse", "free software", "warrant", "liable", "mpl", "to copy")
