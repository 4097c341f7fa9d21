"""License notices and texts looked for by default.

Fixed values: public wording of the notices, which results depend on.  Whole
license texts are in ``license_files``, one file per template.
"""

from pkgutil import get_data

FULL_TEXTS = ["Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0",
              "Artistic-1.0", "GFDL-1.2", "GFDL-1.3"]

#: Words that tell one license from another: those of a notice must all be in the text, besides all words with a digit.
NAMES = set("""apache mit isc bsd gnu gpl general lesser library affero public mozilla mpl creative commons cc by nc nd sa attribution
sharealike alike noncommercial noderivatives noderivs derivatives""".split())
#: Those that must not stand between the words of a notice without them.
VARIANTS = set("lesser library affero nc nd sa sharealike alike noncommercial noderivatives noderivs derivatives".split())

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 header",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
     'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
     "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("MIT notice", "Released under the MIT License."),
    ("MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
     'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
     "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
     "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD clauses",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD disclaimer",
     'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
     "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
     "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
     "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
     "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
     "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
     "OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause third clause",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission."),
    ("AGPL-3.0 section 13",
     "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently "
     "offer all users interacting with it remotely through a computer network (if your version supports such interaction) an "
     "opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a "
     "network server at no charge, through some standard or customary means of facilitating copying of software."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0 notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0 notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
     "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 short notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 short notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0 short notice", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0 notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0 notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0 notice",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All rights reserved", "All rights reserved."),
    ("All rights reserved notice", "All rights reserved. No part of this work may be reproduced without permission."),
]
TEMPLATES += [(name, get_data(__name__, f"license_files/{name}.txt").decode()) for name in FULL_TEXTS]
