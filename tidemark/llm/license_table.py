"""Known licence sentences and the ordered rules over their identifiers."""

from __future__ import annotations

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-name": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-asis": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    ],
    "mit-liable": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "apache-ref": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-asis": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd-names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "bsd-2-ref": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-ref": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2-ref": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl-3-ref": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3-ref": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-ref": ["Licensed under CC BY-ND 4.0."],
    "cc0-ref": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}

# Rules in order, (name, licence, identifiers that follow each other).
RULES = [
    ("mit-full", "MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("mit-short", "MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("mit-grant", "MIT", ("mit-grant", "mit-notice")),
    ("apache-full", "Apache-2.0", ("apache-grant", "apache-copy", "apache-asis", "apache-see")),
    ("apache-grant", "Apache-2.0", ("apache-grant",)),
    ("apache-ref", "Apache-2.0", ("apache-ref",)),
    ("bsd-3-full", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-full", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-ref", "BSD-3-Clause", ("bsd-3-ref",)),
    ("bsd-2-ref", "BSD-2-Clause", ("bsd-2-ref",)),
    ("isc", "ISC", ("isc-grant",)),
    ("gpl-3-full", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("gpl-3-free", "GPL-3.0-or-later", ("gpl-free",)),
    ("gpl-2-full", "GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-see")),
    ("gpl-2-free", "GPL-2.0-or-later", ("gpl-2-free",)),
    ("gpl-3-ref", "GPL-3.0-only", ("gpl-3-ref",)),
    ("gpl-2-ref", "GPL-2.0-only", ("gpl-2-ref",)),
    ("lgpl-3-ref", "LGPL-3.0-only", ("lgpl-3-ref",)),
    ("agpl-3-ref", "AGPL-3.0-only", ("agpl-3-ref",)),
    ("mpl-full", "MPL-2.0", ("mpl-ref", "mpl-copy")),
    ("mpl-ref", "MPL-2.0", ("mpl-ref",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("cc-by-nd", "CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("cc-by", "CC-BY-4.0", ("cc-by-ref",)),
    ("cc0", "CC0-1.0", ("cc0-ref",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("mit-name-ref", "MIT", ("mit-name", "mit-ref")),
    ("mit-ref", "MIT", ("mit-ref",)),
    ("mit-name", "MIT", ("mit-name",)),
    ("reserved", "LicenseRef-all-rights-reserved", ("reserved",)),
]
