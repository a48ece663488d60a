"""Wording of public licenses, as templates: fixed values.

``<<optional>> ... <<end>>`` may be left out, ``<<any 5>>`` stands for up to five words of any kind; only words count, not
the signs between them.
"""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice <<optional>> (including the next paragraph) <<end>> shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND <<any 6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<optional>> 1. <<end>> Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<optional>> 2. <<end>> Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """

_BSD_NAMES = """<<optional>> 3. <<end>> Neither the name of <<any 16>> may be used to endorse or promote products derived from
this software without specific prior written permission. """

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<any 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http <<optional>> s <<end>> www apache org licenses
LICENSE 2 0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

_GPL_NOTICE = """This <<any 4>> is free software <<optional>> you <<end>> <<optional>> ; you <<end>> can redistribute it and/or
modify it under the terms of the GNU <<optional>> Lesser <<end>> <<optional>> Affero <<end>> General Public License as
published by the Free Software Foundation <<optional>> , either <<end>> <<optional>> ; either <<end>> version <<any 2>> of
the License, or (at your option) any later version. <<any 10>> is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
<<optional>> Lesser <<end>> <<optional>> Affero <<end>> General Public License for more details."""

#: Bodies and notices, and their labels.
TEXTS = (
    (_MIT, "mit-text"),
    (_ISC, "isc-text"),
    (_BSD_CONDITIONS + _BSD_DISCLAIMER, "bsd-2-clause-text"),
    (_BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER, "bsd-3-clause-text"),
    (_APACHE_NOTICE, "apache-2.0-notice"),
    (_GPL_NOTICE, "gpl-notice"),
)

#: What may stand before the body, where the whole of a text is to be a license.
HEADER = """<<optional>> <<optional>> the <<end>> <<any 3>> license <<any 2>> <<end>> <<optional>> copyright <<optional>> c <<end>>
<<any 16>> <<optional>> all rights reserved <<end>> <<end>> """
