"""Notices that the licence classifier is trained on and compared with."""

#: Usual notices of licence families, as their stewards word them, and
#: the identifiers by which files name them.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
        "This project is licensed under the terms of the Apache 2.0 license.",
        "Apache License, Version 2.0, January 2004",
        "you may not use this file except in compliance with the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "This project is licensed under the terms of the MIT license.",
        "The MIT License (MIT)",
    ],
    "bsd": [
        "Released under the 3-clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "License: BSD-3-Clause",
        "This project is licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GPLv3+",
        "GPLv2",
        "License: GPL-3.0",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This project is licensed under the GNU GPL version 2 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "LGPLv3",
        "License: LGPL-3.0",
        "This library is licensed under the GNU LGPL version 2.1 or later.",
    ],
    "agpl": [
        "This service is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "AGPLv3",
        "License: AGPL-3.0",
        "This program is licensed under the GNU AGPL version 3 or later.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
        "This project is licensed under the MPL 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY 4.0",
        "License: CC-BY-4.0",
        "This text is available under the Creative Commons Attribution license.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "CC BY-SA 4.0",
        "License: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike license.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "CC BY-NC 4.0",
        "License: CC-BY-NC-4.0",
        "Content is available under the Creative Commons Attribution-NonCommercial license.",
    ],
    "cc0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal",
        "License: CC0-1.0",
        "This work is dedicated to the public domain under CC0.",
    ],
    "proprietary": [
        "Copyright the company. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "All rights reserved.",
        "This document is confidential and proprietary. No part of it may be reproduced without prior written permission.",
        "Unauthorized copying, distribution or use of this software is strictly prohibited. All rights reserved.",
        "SPDX-License-Identifier: LicenseRef-Proprietary",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
        "License: ISC",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
        "Licensed under the zlib License.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "License: EPL-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
        "Licensed under the Boost Software License, version 1.0.",
        "License: BSL-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ],
}

#: Text with the same words that licenses nothing (class unknown).
UNKNOWN: list[str] = [
    "You need a driving license to rent a car here.",
    "The teacher gave permission to leave the class early.",
    "He renewed his fishing license for another year.",
    "The warranty on the washing machine runs for two years.",
    "Copyright law is taught in the second term of the course.",
    "The city issued a license for the new restaurant on the square.",
    "Ask for permission before you take a picture of the public garden.",
    "They plan to redistribute the land among the farmers.",
    "A poetic license lets the writer change the order of events.",
    "The new version of the software has better documentation.",
    "The general public was free to use the library at any time.",
    "The court discussed the terms of the contract and the conditions of the sale.",
    "This work was published by the university press in two volumes.",
    "The license plate of the car was found on the road.",
    "Without warning the warrant was issued by the judge.",
    "The apache helicopter is parked outside of the museum.",
    "Students at the institute in Massachusetts study the permission model of the system.",
    "The company may grant a license, but the terms are not known yet.",
    "See the license for details.",
    "Permission denied.",
    "Drivers must show their license to the officer on request.",
    "The software was released last week and users like the new version.",
    "All members of the family came to the public house by the river.",
    "Rights of way are shown on the map of the county.",
    "The terms of the treaty were kept from the public for years.",
    "Free tickets are available at the door under the usual conditions.",
    "The copy in the library has notes by the author in the margin.",
    "A version of this story was first told by the people of the coast.",
    "The apache people lived in the mountains of the south.",
    "They reserved a table for two and all of them arrived late.",
    "In no event did the mayor speak to the press about the damage.",
    "Changes to the source of the river were seen after the storm.",
    "The commons were open to all who lived in the village.",
    "Attribution of the painting to the master is not certain.",
    "The creative use of common tools is what the course is about.",
    "The foundation was laid in the spring, and the work was done by autumn.",
    "She wrote the original and sold the copyright for a small fee.",
    "No part of the city was without water after the repair.",
    "He asked to use the material for a purpose he did not name.",
    "The document was lost, and no copies of it are known.",
    "The distribution of rain over the year has changed.",
    "This file has the results of the second run.",
    "See the documentation for the list of options.",
    "The program is shown in the evening and can be seen for free.",
    "It is strictly a matter of taste.",
    "The zlib module can be slow for small inputs.",
    "Boost the signal before it goes through the long wire.",
    "The eclipse was seen by the whole town.",
    "The implied meaning of the word is not the same as the express one.",
    "Any person may enter the garden free of charge on Sundays.",
]
