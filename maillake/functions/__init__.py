"""Column builders: every public function takes columns and returns a ``Column``.

They stay inside Catalyst and may be used in ``select``, ``filter`` and in the lambdas of
``transform``/``filter``. Two exceptions run in Arrow batches and say so: ``words`` and the
slow paths of ``dates`` and ``html``.
"""
