"""Inputs with the features that the driver tables lack, in SQL that Spark and DuckDB share."""

from __future__ import annotations

# Sentences by remainder, around the text of a row.
PROMPTS = """
select conv_id * 1000 + turn as prompt_id, role, concat(case (conv_id + turn) % 8
  when 0 then 'Could you please kindly review this. In order to finish, make sure to test it.' || chr(10)
  when 1 then 'I would like you to just explain. It is important to note that this is very important.' || chr(10)
  when 2 then 'There are a lot of   issues due to the fact that it is able to fail.' || chr(10) || 'Requirements:' || chr(10) || '1) First step' || chr(10) || '  2. Second step' || chr(10)
  when 3 then 'it is recommended that you read all of the notes.' || chr(10) || 'Keep every answer short.' || chr(10) || 'keep  every answer SHORT.' || chr(10)
  when 4 then 'please actually take into account each and every   case' || chr(10) || chr(10) || chr(10) || chr(10) || 'There is no need to hurry.' || chr(10)
  when 5 then '# Title' || chr(10) || '- item   one' || chr(10) || '# Title' || chr(10) || 'It is very  hard in terms of time, basically.' || chr(10)
  when 6 then ''
  else '   ' || chr(10) || 'Quite a few things, as well as the vast majority of them, has the ability to grow.' || chr(10) end, coalesce(text, '')) as prompt
from conversations
"""

DOCS = """
select doc_id, concat(
  '# Part ', doc_id % 7, chr(10), chr(10), '##   Notes   on ', source, chr(10), 'Acme Data Systems met Globex Corp on 12 June 2026 in Paris. ',
  case doc_id % 5 when 0 then 'Page 4 of 20' || chr(10) when 1 then 'Copyright © 2026 Acme' || chr(10) when 2 then 'It cost $5.5 million or 300 EUR. Call +1 555 123 4567 now' || chr(10)
    when 3 then '   -   nested    item' || chr(10) else 'Write to ann@acme.example and bob@globex.example. We use Python and redis since 2024-01-31' || chr(10) end,
  text, chr(10), case when doc_id % 3 = 0 then text || chr(10) else '' end, '### End', chr(10), 'Closed.    Done.') as markdown
from documents
"""

PAGED = """
select doc_id, concat('ACME Quarterly Report', chr(10), 'first page of ', doc_id, chr(10), text, chr(10), 'Footer   line', chr(10), chr(10), '---', chr(10), chr(10),
  'ACME  quarterly report', chr(10), '# Heading two', chr(10), 'A line that is long enough to be looked at for repeats in the document ', doc_id, chr(10), 'footer line', chr(10), chr(10), '---', chr(10), chr(10),
  'acme quarterly report', chr(10), 'All rights reserved', chr(10), 'A line that is  long enough to be looked at for repeats in the document ', doc_id, chr(10), 'other end ', doc_id) as markdown
from documents
"""
