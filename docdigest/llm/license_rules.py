"""Signatures of license statements, in order of priority. See ``licenses`` for how they are read.

A line has a label, the keywords that must all occur in a text before the pattern is tried, a score, the pattern and a
statement that it finds. Patterns see lower-cased text; a blank stands for what separates words, a dot for itself.
{l} is "license" in both spellings, {u} a phrase like "licensed under the terms of the". Tiers: of two statements that overlap, the one
of the earlier tier stays; inside a tier the longer one, then the one of the earlier line.
"""

ABBREVIATIONS = {
    "{l}": "licen[sc]e",
    "{u}": "(?:licen[sc]ed|released|distributed|available|provided|published|covered|redistributed) (?:to you )?under (?:the |a |an )?(?:terms (?:and conditions )?of (?:the |a )?)?",
}

#: How the patterns of tags and of grants begin; what follows can also stand further on in a list of licenses.
TAG, GRANT = "spdx {l} identifier", "{u}"
#: Tiers whose statements "not" denies: grants and names.
DENIABLE = (2, 3)

TIERS = [
    # machine-readable tags and addresses of license texts
    """
apache :: spdx apache :: 1.0 :: spdx {l} identifier apache (?:1.0|1.1|2.0) :: SPDX-License-Identifier: Apache-2.0
mit :: spdx mit :: 1.0 :: spdx {l} identifier mit(?: 0)? :: SPDX-License-Identifier: MIT
bsd-2-clause :: spdx bsd :: 1.0 :: spdx {l} identifier bsd 2 clause(?: patent| views)? :: SPDX-License-Identifier: BSD-2-Clause
bsd-3-clause :: spdx bsd :: 1.0 :: spdx {l} identifier bsd 3 clause(?: clear| lbnl)? :: SPDX-License-Identifier: BSD-3-Clause-Clear
bsd-4-clause :: spdx bsd :: 1.0 :: spdx {l} identifier bsd 4 clause(?: uc)? :: SPDX-License-Identifier: BSD-4-Clause
0bsd :: spdx 0bsd :: 1.0 :: spdx {l} identifier 0bsd :: SPDX-License-Identifier: 0BSD
gpl :: spdx gpl :: 1.0 :: spdx {l} identifier gpl [123].[01](?: only| or later)? :: SPDX-License-Identifier: GPL-3.0-or-later
lgpl :: spdx lgpl :: 1.0 :: spdx {l} identifier lgpl (?:2.0|2.1|3.0)(?: only| or later)? :: SPDX-License-Identifier: LGPL-2.1-only
agpl :: spdx agpl :: 1.0 :: spdx {l} identifier agpl [13].0(?: only| or later)? :: SPDX-License-Identifier: AGPL-3.0-only
gfdl :: spdx gfdl :: 1.0 :: spdx {l} identifier gfdl 1.[123](?: only| or later)? :: SPDX-License-Identifier: GFDL-1.3-or-later
mpl :: spdx mpl :: 1.0 :: spdx {l} identifier mpl (?:1.0|1.1|2.0) :: SPDX-License-Identifier: MPL-2.0
epl :: spdx epl :: 1.0 :: spdx {l} identifier epl [12].0 :: SPDX-License-Identifier: EPL-2.0
cddl :: spdx cddl :: 1.0 :: spdx {l} identifier cddl 1.[01] :: SPDX-License-Identifier: CDDL-1.0
cpl :: spdx cpl :: 1.0 :: spdx {l} identifier cpl 1.0 :: SPDX-License-Identifier: CPL-1.0
eupl :: spdx eupl :: 1.0 :: spdx {l} identifier eupl 1.[012] :: SPDX-License-Identifier: EUPL-1.2
osl :: spdx osl :: 1.0 :: spdx {l} identifier osl (?:1.0|1.1|2.0|2.1|3.0) :: SPDX-License-Identifier: OSL-3.0
afl :: spdx afl :: 1.0 :: spdx {l} identifier afl (?:1.1|1.2|2.0|2.1|3.0) :: SPDX-License-Identifier: AFL-3.0
artistic :: spdx artistic :: 1.0 :: spdx {l} identifier artistic [12].0 :: SPDX-License-Identifier: Artistic-2.0
bsl :: spdx bsl :: 1.0 :: spdx {l} identifier bsl 1.0 :: SPDX-License-Identifier: BSL-1.0
busl :: spdx busl :: 1.0 :: spdx {l} identifier busl 1.1 :: SPDX-License-Identifier: BUSL-1.1
isc :: spdx isc :: 1.0 :: spdx {l} identifier isc :: SPDX-License-Identifier: ISC
zlib :: spdx zlib :: 1.0 :: spdx {l} identifier zlib :: SPDX-License-Identifier: Zlib
unlicense :: spdx unlicense :: 1.0 :: spdx {l} identifier unlicense :: SPDX-License-Identifier: Unlicense
wtfpl :: spdx wtfpl :: 1.0 :: spdx {l} identifier wtfpl :: SPDX-License-Identifier: WTFPL
python :: spdx python :: 1.0 :: spdx {l} identifier (?:python|psf) 2.0 :: SPDX-License-Identifier: Python-2.0
php :: spdx php :: 1.0 :: spdx {l} identifier php 3.01? :: SPDX-License-Identifier: PHP-3.01
ncsa :: spdx ncsa :: 1.0 :: spdx {l} identifier ncsa :: SPDX-License-Identifier: NCSA
postgresql :: spdx postgresql :: 1.0 :: spdx {l} identifier postgresql :: SPDX-License-Identifier: PostgreSQL
openssl :: spdx openssl :: 1.0 :: spdx {l} identifier openssl :: SPDX-License-Identifier: OpenSSL
ms-pl :: spdx ms :: 1.0 :: spdx {l} identifier ms pl :: SPDX-License-Identifier: MS-PL
ms-rl :: spdx ms :: 1.0 :: spdx {l} identifier ms rl :: SPDX-License-Identifier: MS-RL
ofl :: spdx ofl :: 1.0 :: spdx {l} identifier ofl 1.[01] :: SPDX-License-Identifier: OFL-1.1
odbl :: spdx odbl :: 1.0 :: spdx {l} identifier odbl 1.0 :: SPDX-License-Identifier: ODbL-1.0
odc-by :: spdx odc :: 1.0 :: spdx {l} identifier odc by 1.0 :: SPDX-License-Identifier: ODC-By-1.0
pddl :: spdx pddl :: 1.0 :: spdx {l} identifier pddl 1.0 :: SPDX-License-Identifier: PDDL-1.0
upl :: spdx upl :: 1.0 :: spdx {l} identifier upl 1.0 :: SPDX-License-Identifier: UPL-1.0
zpl :: spdx zpl :: 1.0 :: spdx {l} identifier zpl (?:1.1|2.0|2.1) :: SPDX-License-Identifier: ZPL-2.1
sspl :: spdx sspl :: 1.0 :: spdx {l} identifier sspl 1.0 :: SPDX-License-Identifier: SSPL-1.0
elastic :: spdx elastic :: 1.0 :: spdx {l} identifier elastic 2.0 :: SPDX-License-Identifier: Elastic-2.0
blueoak :: spdx blueoak :: 1.0 :: spdx {l} identifier blueoak 1.0.0 :: SPDX-License-Identifier: BlueOak-1.0.0
mulan :: spdx mulanpsl :: 1.0 :: spdx {l} identifier mulanpsl [12].0 :: SPDX-License-Identifier: MulanPSL-2.0
polyform :: spdx polyform :: 1.0 :: spdx {l} identifier polyform (?:noncommercial|small business) 1.0.0 :: SPDX-License-Identifier: PolyForm-Noncommercial-1.0.0
cc0 :: spdx cc0 :: 1.0 :: spdx {l} identifier cc0 1.0 :: SPDX-License-Identifier: CC0-1.0
cc-by-sa :: spdx cc :: 1.0 :: spdx {l} identifier cc by sa [1-4].[05] :: SPDX-License-Identifier: CC-BY-SA-4.0
cc-by-nc :: spdx cc :: 1.0 :: spdx {l} identifier cc by nc [1-4].[05] :: SPDX-License-Identifier: CC-BY-NC-4.0
cc-by :: spdx cc :: 1.0 :: spdx {l} identifier cc by [1-4].[05] :: SPDX-License-Identifier: CC-BY-4.0
apache :: apache.org :: 1.0 :: apache org licenses(?: {l} 2.0)? :: http://www.apache.org/licenses/LICENSE-2.0
gpl :: gnu.org :: 0.95 :: gnu org licenses (?:old licenses )?gpl(?: [123].0)? :: https://www.gnu.org/licenses/gpl-3.0.html
lgpl :: gnu.org :: 0.95 :: gnu org licenses (?:old licenses )?lgpl(?: [23].[01])? :: https://www.gnu.org/licenses/lgpl-2.1.html
agpl :: gnu.org :: 0.95 :: gnu org licenses agpl(?: 3.0)? :: https://www.gnu.org/licenses/agpl-3.0.html
gfdl :: gnu.org :: 0.95 :: gnu org (?:licenses|copyleft) fdl(?: 1.[123])? :: https://www.gnu.org/licenses/fdl-1.3.html
mpl :: mozilla.org :: 0.95 :: mozilla org (?:en us )?mpl(?: [12].[01])? :: https://mozilla.org/MPL/2.0/
epl :: eclipse.org :: 0.95 :: eclipse org legal epl(?: v10| 2.0| v20)? :: https://www.eclipse.org/legal/epl-2.0
mit :: opensource.org :: 0.95 :: opensource org licenses? mit(?: {l})? :: https://opensource.org/licenses/MIT
bsd :: opensource.org :: 0.95 :: opensource org licenses? bsd(?: [234] clause| {l})? :: https://opensource.org/licenses/BSD-3-Clause
bsl :: boost.org :: 0.95 :: boost org {l} 1 0 :: https://www.boost.org/LICENSE_1_0.txt
unlicense :: unlicense.org :: 0.95 :: unlicense org :: see <https://unlicense.org>
cc-by-nc-nd :: creativecommons.org :: 1.0 :: creativecommons org licenses by nc nd(?: [1-4].[05])? :: https://creativecommons.org/licenses/by-nc-nd/4.0/
cc-by-nc-sa :: creativecommons.org :: 1.0 :: creativecommons org licenses by nc sa(?: [1-4].[05])? :: https://creativecommons.org/licenses/by-nc-sa/4.0/
cc-by-nc :: creativecommons.org :: 1.0 :: creativecommons org licenses by nc(?: [1-4].[05])? :: https://creativecommons.org/licenses/by-nc/4.0/
cc-by-nd :: creativecommons.org :: 1.0 :: creativecommons org licenses by nd(?: [1-4].[05])? :: https://creativecommons.org/licenses/by-nd/3.0/
cc-by-sa :: creativecommons.org :: 1.0 :: creativecommons org licenses by sa(?: [1-4].[05])? :: https://creativecommons.org/licenses/by-sa/3.0/
cc-by :: creativecommons.org :: 1.0 :: creativecommons org licenses by(?: [1-4].[05])? :: https://creativecommons.org/licenses/by/4.0/
cc0 :: creativecommons.org :: 1.0 :: creativecommons org publicdomain zero(?: 1.0)? :: https://creativecommons.org/publicdomain/zero/1.0/
public-domain :: creativecommons.org :: 1.0 :: creativecommons org publicdomain mark(?: 1.0)? :: https://creativecommons.org/publicdomain/mark/1.0/
ofl :: scripts.sil.org :: 0.95 :: scripts sil org ofl :: https://scripts.sil.org/OFL
odbl :: opendatacommons.org :: 0.95 :: opendatacommons org licenses odbl(?: 1.0)? :: http://opendatacommons.org/licenses/odbl/1.0/
odc-by :: opendatacommons.org :: 0.95 :: opendatacommons org licenses by(?: 1.0)? :: http://opendatacommons.org/licenses/by/1.0/
pddl :: opendatacommons.org :: 0.95 :: opendatacommons org licenses pddl(?: 1.0)? :: http://opendatacommons.org/licenses/pddl/1.0/
""",
    # sentences of the license texts
    """
mit :: permission granted free charge :: 0.9 :: permission is hereby granted free of charge to any person obtaining a copy :: Permission is hereby granted, free of charge, to any person obtaining a copy
mit :: software warranty kind :: 0.8 :: the software is provided as is without warranty of any kind express or implied :: THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED
isc :: permission purpose fee :: 0.9 :: permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee :: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
bsd :: redistribution source binary :: 0.9 :: redistribution and use in source and binary forms with or without modification are permitted :: Redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause :: endorse promote :: 0.9 :: may be used to endorse or promote products derived from this software :: may be used to endorse or promote products derived from this software
bsd-4-clause :: advertising materials :: 0.9 :: all advertising materials mentioning features or use of this software must display :: All advertising materials mentioning features or use of this software must display
apache :: compliance license :: 0.9 :: you may not use this file except in compliance with the {l} :: you may not use this file except in compliance with the License
gpl :: redistribute modify general public :: 0.95 :: you can redistribute it and or modify it under the terms of the gnu general public {l} :: you can redistribute it and/or modify it under the terms of the GNU General Public License
lgpl :: redistribute modify lesser :: 0.95 :: you can redistribute it and or modify it under the terms of the gnu lesser general public {l} :: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
agpl :: redistribute modify affero :: 0.95 :: you can redistribute it and or modify it under the terms of the gnu affero general public {l} :: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
gfdl :: permission document free documentation :: 0.95 :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {l} :: Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License
mpl :: source code form mozilla :: 0.95 :: this source code form is subject to the terms of the mozilla public {l} :: This Source Code Form is subject to the terms of the Mozilla Public License
zlib :: implied event :: 0.9 :: this software is provided as is without any express or implied warranty in no event will the authors be held liable :: This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
bsl :: permission granted free charge accompanying :: 0.9 :: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation :: Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
unlicense :: free unencumbered :: 0.95 :: this is free and unencumbered software released into the public domain :: This is free and unencumbered software released into the public domain.
wtfpl :: everyone permitted verbatim :: 0.7 :: everyone is permitted to copy and distribute verbatim or modified copies of this {l} document and changing it is allowed :: Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
gpl :: everyone permitted verbatim changing :: 0.7 :: everyone is permitted to copy and distribute verbatim copies of this {l} document but changing it is not allowed :: Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
cc0 :: waived copyright related :: 0.8 :: waived all copyright and related or neighboring rights :: has waived all copyright and related or neighboring rights
cc-by :: share adapt attribution :: 0.8 :: you are free to share and adapt as long as you give attribution :: You are free to share and adapt, as long as you give attribution
proprietary :: unauthorized copying :: 0.85 :: unauthorized copying of this (?:file|document|software|work) (?:via any medium )?is strictly prohibited :: Unauthorized copying of this file, via any medium is strictly prohibited
proprietary :: reproduced transmitted :: 0.85 :: no part of this (?:book|publication|document|work|site) may be reproduced(?: stored)?(?: or| distributed or)?(?: transmitted)? :: No part of this publication may be reproduced, distributed, or transmitted
proprietary :: reproduced permission :: 0.8 :: may not be (?:reproduced|copied|republished|redistributed) without (?:prior |the )*(?:express |written )*permission :: may not be reproduced without prior written permission
""",
    # grants that name a license
    """
apache :: under apache :: 0.95 :: {u}apache(?: software)?(?: {l})?(?: (?:version |v)?(?:1.0|1.1|2.0|2))? :: Licensed under the Apache License, Version 2.0
mit :: under mit :: 0.95 :: {u}mit(?: expat)?(?: x11)?(?: {l})? :: Released under the MIT License
bsd-2-clause :: under bsd :: 0.95 :: {u}(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {l})? :: distributed under the 2-Clause BSD License
bsd-3-clause :: under bsd :: 0.95 :: {u}(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {l})? :: licensed under the BSD 3-Clause License
bsd :: under bsd :: 0.9 :: {u}bsd(?: style)?(?: {l})? :: available under a BSD-style license
gpl :: under general public :: 0.95 :: {u}(?:gnu )?general public {l}(?: (?:version |v)?[123](?:.0)?)?(?: or (?:any )?later(?: version)?)? :: distributed under the terms of the GNU General Public License, version 2 or later
gpl :: under gpl :: 0.95 :: {u}(?:gnu )?gpl(?: ?v?[123](?:.0)?)?(?: or later| only)? :: licensed under the GPLv3 or later
lgpl :: under lesser :: 0.95 :: {u}(?:gnu )?lesser general public {l}(?: (?:version |v)?(?:2.1|3.0|3))? :: released under the GNU Lesser General Public License v3.0
lgpl :: under library general :: 0.95 :: {u}(?:gnu )?library general public {l}(?: (?:version |v)?2(?:.0)?)? :: distributed under the GNU Library General Public License, version 2
lgpl :: under lgpl :: 0.95 :: {u}(?:gnu )?lgpl(?: ?v?(?:2.1|2|3)(?:.0)?)? :: licensed under LGPL 2.1
agpl :: under affero :: 0.95 :: {u}(?:gnu )?affero general public {l}(?: (?:version |v)?[13](?:.0)?)? :: licensed under the GNU Affero General Public License v3
agpl :: under agpl :: 0.95 :: {u}(?:gnu )?agpl(?: ?v?[13](?:.0)?)? :: available under the AGPLv3
gfdl :: under free documentation :: 0.95 :: {u}(?:gnu )?free documentation {l}(?: (?:version |v)?1.[123])? :: available under the GNU Free Documentation License, Version 1.2
mpl :: under mozilla :: 0.95 :: {u}mozilla public {l}(?: (?:version |v)?[12](?:.[01])?)? :: released under the Mozilla Public License 2.0
mpl :: under mpl :: 0.9 :: {u}mpl(?: (?:version |v)?[12](?:.[01])?)? :: licensed under MPL 2.0
epl :: under eclipse :: 0.95 :: {u}eclipse public {l}(?: (?:version |v)?[12](?:.0)?)? :: licensed under the Eclipse Public License v2.0
edl :: under eclipse distribution :: 0.95 :: {u}eclipse distribution {l}(?: (?:version |v)?1.0)? :: distributed under the Eclipse Distribution License v1.0
cddl :: under common development :: 0.95 :: {u}common development and distribution {l}(?: (?:version |v)?1.[01])? :: licensed under the Common Development and Distribution License
cpl :: under common public :: 0.95 :: {u}common public {l}(?: (?:version |v)?1.0)? :: made available under the Common Public License
eupl :: under european union :: 0.95 :: {u}european union public licen[sc]e(?: (?:version |v)?1.[012])? :: Licensed under the European Union Public Licence v1.2
osl :: under open software :: 0.95 :: {u}open software {l}(?: (?:version |v)?[123].[01])? :: licensed under the Open Software License version 3.0
afl :: under academic free :: 0.95 :: {u}academic free {l}(?: (?:version |v)?[123].[012])? :: licensed under the Academic Free License version 2.1
artistic :: under artistic :: 0.95 :: {u}(?:clarified |perl )?artistic {l}(?: (?:version |v)?[12](?:.0)?)? :: distributed under the Artistic License 2.0
bsl :: under boost :: 0.95 :: {u}boost software {l}(?: (?:version |v)?1.0)? :: Distributed under the Boost Software License, Version 1.0
busl :: under business source :: 0.95 :: {u}business source {l}(?: (?:version |v)?1.1)? :: licensed under the Business Source License 1.1
isc :: under isc :: 0.95 :: {u}isc(?: {l})? :: released under the ISC license
zlib :: under zlib :: 0.95 :: {u}zlib(?: libpng)?(?: {l})? :: distributed under the zlib/libpng license
unlicense :: under unlicense :: 0.95 :: {u}unlicense :: released under the Unlicense
wtfpl :: under wtfpl :: 0.95 :: {u}wtfpl(?: (?:version |v)?2)? :: licensed under the WTFPL
python :: under python :: 0.95 :: {u}(?:python software foundation|python|psf) {l}(?: (?:version )?2)? :: licensed under the Python Software Foundation License
php :: under php :: 0.95 :: {u}php {l}(?: (?:version )?3.01?)? :: subject to and available under the PHP license
ruby :: under ruby :: 0.9 :: {u}(?:same terms as ruby|ruby {l}|ruby s {l}) :: distributed under the Ruby license
perl :: terms perl :: 0.9 :: under the same terms as perl(?: itself)?(?: 5)? :: you may use it under the same terms as Perl itself
ncsa :: under illinois :: 0.95 :: {u}university of illinois(?: ncsa)? open source {l} :: distributed under the University of Illinois/NCSA Open Source License
postgresql :: under postgresql :: 0.95 :: {u}postgresql {l} :: released under the PostgreSQL License
openssl :: under openssl :: 0.95 :: {u}openssl(?: and ssleay)? {l}s? :: licensed under the OpenSSL license
ms-pl :: under microsoft public :: 0.95 :: {u}microsoft public {l} :: licensed under the Microsoft Public License
ms-rl :: under microsoft reciprocal :: 0.95 :: {u}microsoft reciprocal {l} :: licensed under the Microsoft Reciprocal License
ofl :: under open font :: 0.95 :: {u}sil open font {l}(?: (?:version )?1.[01])? :: licensed under the SIL Open Font License, Version 1.1
odbl :: under open database :: 0.95 :: {u}(?:open data commons )?open database {l}(?: (?:version |v)?1.0)? :: made available under the Open Database License
odc-by :: under open data commons :: 0.95 :: {u}open data commons attribution {l}(?: (?:version |v)?1.0)? :: made available under the Open Data Commons Attribution License
pddl :: public domain dedication :: 0.95 :: {u}public domain dedication and {l}(?: (?:version |v)?1.0)? :: made available under the Public Domain Dedication and License v1.0
upl :: under universal permissive :: 0.95 :: {u}universal permissive {l}(?: (?:version |v)?1.0)? :: Licensed under the Universal Permissive License v 1.0
zpl :: under zope :: 0.95 :: {u}zope public {l}(?: (?:version |v)?[12].[01])? :: subject to and distributed under the Zope Public License, Version 2.1
sspl :: under server side :: 0.95 :: {u}server side public {l}(?: (?:version |v)?1)? :: licensed under the Server Side Public License v1
elastic :: under elastic :: 0.95 :: {u}elastic {l}(?: (?:version |v)?2.0)? :: licensed under the Elastic License 2.0
blueoak :: under blue oak :: 0.95 :: {u}blue oak model {l}(?: 1.0.0)? :: licensed under the Blue Oak Model License 1.0.0
mulan :: under mulan :: 0.95 :: {u}mulan (?:psl|permissive software {l})(?: (?:version |v)?[12])? :: licensed under the Mulan PSL v2
polyform :: under polyform :: 0.95 :: {u}polyform (?:noncommercial|small business|free trial|internal use|perimeter|shield|strict) {l}(?: 1.0.[01])? :: licensed under the PolyForm Shield License 1.0.0
fsl :: under functional source :: 0.95 :: {u}functional source {l}(?: (?:version |v)?1.[01])? :: available under the Functional Source License, Version 1.1
cecill :: under cecill :: 0.95 :: {u}cecill(?: [bc])?(?: {l})?(?: (?:version |v)?[12].[01])? :: distributed under the CeCILL-B license
openrail :: under openrail :: 0.9 :: {u}(?:creativeml |bigscience )?open ?rail(?: m)?(?: {l})? :: released under the CreativeML OpenRAIL-M license
llama :: under llama :: 0.9 :: {u}llama (?:2|3|3.1) community {l} :: licensed under the Llama 2 Community License
cc-by-nc-nd :: creative commons :: 0.95 :: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: (?:work )?{l})?(?: [1-4].[05])?(?: international| unported)? :: Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International
cc-by-nc-sa :: creative commons :: 0.95 :: creative commons attribution non ?commercial share ?alike(?: {l})?(?: [1-4].[05])?(?: international| unported)? :: Creative Commons Attribution-NonCommercial-ShareAlike 4.0
cc-by-nc :: creative commons :: 0.95 :: creative commons attribution non ?commercial(?: {l})?(?: [1-4].[05])?(?: international| unported)? :: Creative Commons Attribution-NonCommercial 4.0
cc-by-nd :: creative commons :: 0.95 :: creative commons attribution no ?deriv(?:ative)?s?(?: {l})?(?: [1-4].[05])?(?: international| unported)? :: Creative Commons Attribution-NoDerivs 3.0 Unported
cc-by-sa :: creative commons :: 0.95 :: creative commons attribution share ?alike(?: {l})?(?: [1-4].[05])?(?: international| unported)? :: Creative Commons Attribution-ShareAlike 3.0 Unported
cc-by :: creative commons :: 0.95 :: creative commons attribution(?: {l})?(?: [1-4].[05])?(?: international| unported)? :: Creative Commons Attribution 4.0 International
cc0 :: creative commons :: 0.95 :: creative commons (?:zero|cc0)(?: 1.0)?(?: universal)? :: Creative Commons Zero 1.0
public-domain :: public domain :: 0.85 :: (?:dedicated to|released (?:in)?to|placed (?:in|into)) the public domain :: placed in the public domain
""",
    # names
    """
cc-by-nc-nd :: cc nc nd :: 0.9 :: cc by nc nd(?: [1-4].[05])? :: CC BY-NC-ND 4.0
cc-by-nc-sa :: cc nc sa :: 0.9 :: cc by nc sa(?: [1-4].[05])? :: CC-BY-NC-SA
cc-by-nc :: cc nc :: 0.9 :: cc by nc(?: [1-4].[05])? :: CC BY-NC 4.0
cc-by-nd :: cc nd :: 0.9 :: cc by nd(?: [1-4].[05])? :: CC BY-ND 3.0
cc-by-sa :: cc sa :: 0.9 :: cc by sa(?: [1-4].[05])? :: CC BY-SA 3.0
cc-by :: cc by :: 0.9 :: cc by(?: [1-4].[05])? :: CC BY 4.0
cc0 :: cc0 :: 0.9 :: cc0(?: 1.0)?(?: universal)? :: CC0 1.0
apache :: apache :: 0.8 :: apache(?: software)? {l}(?: (?:version |v)?(?:1.0|1.1|2.0|2))? :: the Apache License 2.0
mit :: mit :: 0.8 :: (?:mit|expat|mit x11) {l} :: MIT license
bsd-2-clause :: bsd :: 0.8 :: (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) {l} :: the FreeBSD license
bsd-3-clause :: bsd :: 0.8 :: (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) {l} :: the Modified BSD License
bsd-4-clause :: bsd :: 0.8 :: (?:bsd 4 clause|4 clause bsd|original bsd) {l} :: the original BSD license
bsd :: bsd :: 0.8 :: bsd(?: style)? {l} :: BSD license
0bsd :: bsd :: 0.8 :: (?:0bsd|zero clause bsd)(?: {l})? :: the Zero-Clause BSD licence
gpl :: general public :: 0.8 :: (?:gnu )?general public {l}(?: (?:version |v)?[123](?:.0)?)? :: the GNU General Public License
gpl :: gpl :: 0.7 :: (?:gnu gpl|gpl ?v[123]|gpl [123].[01]|gpl {l}) :: GPLv2
lgpl :: lesser :: 0.8 :: (?:gnu )?lesser general public {l}(?: (?:version |v)?(?:2.1|3))? :: GNU Lesser General Public License
lgpl :: lgpl :: 0.7 :: (?:gnu )?lgpl(?: ?v?[23](?:.[01])?)? :: LGPLv3
agpl :: affero :: 0.8 :: (?:gnu )?affero general public {l}(?: (?:version |v)?[13])? :: GNU Affero General Public License
agpl :: agpl :: 0.7 :: (?:gnu )?agpl(?: ?v?[13](?:.0)?)? :: AGPL-3.0
gfdl :: free documentation :: 0.8 :: (?:gnu )?free documentation {l}(?: (?:version |v)?1.[123])? :: GNU Free Documentation License
mpl :: mozilla :: 0.8 :: mozilla public {l}(?: (?:version |v)?[12](?:.[01])?)? :: Mozilla Public License
mpl :: mpl :: 0.7 :: mpl (?:v|version )?[12].[01] :: MPL 2.0
epl :: eclipse :: 0.8 :: eclipse public {l}(?: (?:version |v)?[12](?:.0)?)? :: Eclipse Public License 1.0
cddl :: common development :: 0.8 :: common development and distribution {l} :: Common Development and Distribution License
eupl :: eupl :: 0.8 :: eupl(?: v?1.[012])? :: EUPL v1.2
artistic :: artistic :: 0.8 :: (?:clarified |perl )?artistic {l}(?: [12].0)? :: the Artistic License
bsl :: boost :: 0.8 :: boost software {l}(?: 1.0)? :: Boost Software License
isc :: isc :: 0.8 :: (?:isc|internet systems consortium) {l} :: ISC licence
zlib :: zlib :: 0.8 :: zlib(?: libpng)? {l} :: zlib license
unlicense :: unlicense :: 0.8 :: the unlicense :: The Unlicense
wtfpl :: what the fuck :: 0.8 :: do what the fuck you want to public {l} :: Do What The Fuck You Want To Public License
wtfpl :: wtfpl :: 0.7 :: wtfpl :: WTFPL
ms-pl :: microsoft public :: 0.8 :: microsoft public {l} :: Microsoft Public License
ofl :: open font :: 0.8 :: (?:sil )?open font {l}(?: 1.1)? :: SIL Open Font License
odbl :: odbl :: 0.8 :: odbl(?: (?:v|version )?1.0)? :: ODbL 1.0
busl :: business source :: 0.8 :: business source {l}(?: (?:version |v)?1.1)? :: Business Source License 1.1
elastic :: elastic :: 0.8 :: elastic {l}(?: (?:version |v)?2(?:.0)?)? :: Elastic License 2.0
blueoak :: blueoak :: 0.8 :: blueoak 1.0.0 :: BlueOak-1.0.0
blueoak :: blue oak :: 0.8 :: blue oak model {l}(?: 1.0.0)? :: Blue Oak Model License
mulan :: mulan :: 0.8 :: mulan (?:psl|permissive software {l})(?: (?:version |v)?[12])? :: Mulan Permissive Software License, Version 2
polyform :: polyform :: 0.8 :: polyform (?:noncommercial|small business|free trial|internal use|perimeter|shield|strict) {l}(?: 1.0.[01])? :: PolyForm Noncommercial License
fsl :: functional source :: 0.8 :: functional source {l}(?: (?:version |v)?1.[01])? :: Functional Source License
sspl :: sspl :: 0.8 :: sspl(?: ?v?1)? :: SSPL v1
""",
    # weak signs
    """
reserved :: rights reserved :: 0.6 :: (?:all|some|no) rights reserved :: All rights reserved.
copyright :: copyright :: 0.5 :: copyright (?:c )?[12][0-9]{3} :: Copyright (c) 2021
proprietary :: proprietary confidential :: 0.7 :: proprietary and confidential :: Proprietary and confidential
proprietary :: personal use :: 0.5 :: for personal(?: and)? non ?commercial use only :: For personal, non-commercial use only
public-domain :: public domain :: 0.6 :: in the public domain :: This work is in the public domain
""",
]
