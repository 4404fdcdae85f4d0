"""stridelake: analytics over multichannel time series, labelled datasets and judgment logs on plain PySpark."""
