"""Training-data operators over research reports, report pages and factor exposures.

The records are those of the panel library: a report has ``external_id``, ``source`` and
``content_text``; a crawled report page has ``external_id``, ``source_url`` and ``html``; an
exposure row has ``ts_code`` and ``features``. Ids may be of any orderable type.
"""
