"""SQL text of the test-data mapping, for the DuckDB oracle.

Each oracle query is ``ENTITIES + <select>``: the CTEs below derive the billing
entities from the pre-registered star-schema views with the FIXTURES.md rules.
The entity customer is named ``cust`` because ``customer`` is the source view.
"""

ENTITIES = """
WITH utility_type(UtilityID, UtilityName, Unit) AS (
  VALUES ('UTIL-01', 'Electricity', 'kWh'), ('UTIL-02', 'Water', 'm3'), ('UTIL-03', 'Gas', 'unit')
),
tariff AS (
  SELECT TariffID, UtilityID, TariffName, CAST(Rate AS DECIMAL(10,2)) AS Rate,
         CAST(MinUnits AS INTEGER) AS MinUnits, CAST(MaxUnits AS INTEGER) AS MaxUnits,
         CAST(FixedCharge AS DECIMAL(10,2)) AS FixedCharge
  FROM (VALUES
    ('ELEC-01', 'UTIL-01', 'Domestic (0-60 kWh)', 30.00, 0, 60, 100.00),
    ('ELEC-02', 'UTIL-01', 'Domestic (60-120 kWh)', 45.00, 60, 120, 0.00),
    ('ELEC-03', 'UTIL-01', 'Domestic (120+ kWh)', 60.00, 120, NULL, 0.00),
    ('WATR-01', 'UTIL-02', 'Water base', 20.00, 0, NULL, 0.00),
    ('WATR-02', 'UTIL-02', 'Water high', 35.00, 50, NULL, 0.00),
    ('GAS-01', 'UTIL-03', 'Gas flat', 15.50, 0, NULL, 0.00)
  ) t(TariffID, UtilityID, TariffName, Rate, MinUnits, MaxUnits, FixedCharge)
),
cust AS (
  SELECT 'CUST-' || CAST(c.c_custkey AS VARCHAR) AS CustomerID,
         c.c_name AS CustomerName,
         CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Household' WHEN 'BUILDING' THEN 'Government'
              ELSE 'Business' END AS CustomerType,
         CASE WHEN c.c_custkey % 4 = 0 THEN NULL
              ELSE 'c' || CAST(c.c_custkey AS VARCHAR) || '@example.test' END AS Email,
         '07' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') AS Phone,
         n.n_name AS ServiceAddress,
         CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE n.n_name END AS BillingAddress,
         CAST(DATE '1995-01-01' + CAST((c.c_custkey * 7) % 2400 AS INTEGER) AS DATE) AS RegistrationDate
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
meter AS (
  SELECT 'MTR-' || CAST(c_custkey AS VARCHAR) AS MeterID,
         'CUST-' || CAST(c_custkey AS VARCHAR) AS CustomerID,
         'UTIL-0' || CAST(c_custkey % 3 + 1 AS VARCHAR) AS UtilityID,
         CASE c_custkey % 10 WHEN 0 THEN 'Inactive' WHEN 1 THEN 'Pending Install' ELSE 'Active' END AS Status,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Block ' || CAST(c_nationkey AS VARCHAR) END AS Location,
         DATE '1995-01-01' AS InstallDate
  FROM customer
),
meter_reading AS (
  SELECT CAST(event_id AS BIGINT) AS ReadingID,
         'MTR-' || CAST(user_id AS VARCHAR) AS MeterID,
         'U-00' || CAST(event_id % 5 + 1 AS VARCHAR) AS UserID,
         CAST(SUM(CAST(value AS DECIMAL(10,2))) OVER (
              PARTITION BY user_id ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(10,2)) AS ReadingValue,
         CAST(ts AS DATE) AS ReadingDate,
         CASE WHEN event_type = 'error' THEN 'error' END AS Notes
  FROM events
),
order_qty AS (
  SELECT l_orderkey, SUM(CAST(l_quantity AS DECIMAL(10,2))) AS q FROM lineitem GROUP BY l_orderkey
),
bill AS (
  SELECT 'BILL-' || CAST(o.o_orderkey AS VARCHAR) AS BillID,
         'CUST-' || CAST(o.o_custkey AS VARCHAR) AS CustomerID,
         'MTR-' || CAST(o.o_custkey AS VARCHAR) AS MeterID,
         CAST(o.o_orderkey * 2 AS BIGINT) AS ReadingID,
         CASE o.o_custkey % 3 WHEN 0 THEN 'ELEC-01' WHEN 1 THEN 'WATR-01' ELSE 'GAS-01' END AS TariffID,
         CAST(o.o_orderdate AS DATE) AS BillDate,
         CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 14 DAY AS DATE) AS DueDate,
         CAST(NULL AS DECIMAL(10,2)) AS PreviousReadingValue,
         CAST(NULL AS DECIMAL(10,2)) AS CurrentReadingValue,
         CAST(q.q AS DECIMAL(10,2)) AS Consumption,
         CAST(o.o_totalprice AS DECIMAL(10,2)) AS AmountDue,
         CASE o.o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' WHEN 'P' THEN 'Overdue' END AS Status
  FROM orders o LEFT JOIN order_qty q ON o.o_orderkey = q.l_orderkey
),
payment AS (
  SELECT 'PAY-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
           || CAST(l_partkey AS VARCHAR) AS PaymentID,
         'BILL-' || CAST(l_orderkey AS VARCHAR) AS BillID,
         'U-' || CAST(l_suppkey AS VARCHAR) AS UserID,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS PaymentAmount,
         l_shipdate + INTERVAL 1 HOUR * CAST(l_quantity % 24 AS INTEGER) AS PaymentDate,
         CASE l_returnflag WHEN 'A' THEN 'Cash' WHEN 'N' THEN 'Card' WHEN 'R' THEN 'Online' END AS PaymentMethod
  FROM lineitem
)
"""
