"""doseloom: cohort genetic scoring and association analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing here holds
global state. Modules:

* ``sources``   typed readers and partitioned writers
* ``functions`` column expressions (genotype dosage, text cleaning, p-values)
* ``operators`` cohort selection, matching, scoring, ranking, association, ...
* ``models``    classifiers on MLlib, folds, grids, feature tables
* ``plans``     end-to-end jobs, materialised steps, size checks
"""
